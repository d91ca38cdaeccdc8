"""Benchmark decontamination that also catches re-parameterised questions.

Numbers, units and names become typed placeholders, so a question with other values has the same template. Windows of
five template words of the benchmark are matched against those of the documents. A match counts only if its slots are
consistent: along one alignment, a value of the benchmark item stands for one value of the document, the one it meets
most often; windows with another value are dropped, those that are equal word for word always count.

Few documents hold anything of a benchmark, so most are ruled out before any template is built. A document that holds an
item misses at most a fifth of its windows, so of any larger choice of the item's windows it holds one, and with it that
window's plain words. The choice falls on the windows with the longest pairs of neighbouring plain words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import numbered, table, written

WINDOW = 5
SIMILARITY = 0.8

# Words read as a unit when they follow a number, in English, German, Spanish and French.
UNITS = (
    "km kilometers kilometres kilometer kilometre miles mile meters metres meter metre m cm mm feet foot ft inches inch yards yard "
    "kg kilograms kilogram grams gram g mg pounds pound lbs lb ounces ounce oz tons ton "
    "liters litres liter litre l ml gallons gallon cups cup "
    "seconds second sec minutes minute min hours hour h days day weeks week months month years year "
    "dollars dollar cents cent euros euro percent degrees degree kmh mph watts watt volts volt "
    "kilometern metern meile meilen zentimeter millimeter kilo kilogramm gramm pfund tonnen tonne sekunden sekunde minuten stunden stunde tage tag "
    "wochen woche monate monat jahre jahr prozent grad "
    "kilómetros kilómetro metros metro millas milla centímetros kilos kilogramos gramos toneladas litros litro segundos minutos horas hora días día "
    "semanas semana meses mes años año dólares centavos grados "
    "kilomètres kilomètre mètres mètre milles centimètres kilogrammes grammes tonnes litres secondes heures heure jours jour semaines semaine mois ans "
    "années année pourcent degrés"
).split()

# Words read as a number, in the same languages, without those that are articles or other words as well.
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "zwei drei vier fünf sechs sieben acht neun zehn zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn "
    "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis diecisiete dieciocho diecinueve "
    "veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien "
    "deux trois quatre cinq sept huit dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante mille"
).split()

# A token is a run of letters and digits, or a marked slot: mark, then the value.
NUMBER, NAME, UNIT, MAYBE = "\u0001", "\u0002", "\u0003", "\u0004"
_APART = r"(?![\p{L}\p{N}])"
_NUMBER = rf"(?<![\p{{L}}\p{{N}}])(?:\p{{Nd}}+(?:[.,:/]\p{{Nd}}+)*|(?iu:{'|'.join(dict.fromkeys(NUMBER_WORDS))}){_APART})"
_UNIT = rf"({NUMBER}(?:[\p{{Nd}}.,:/]+\s?|\p{{L}}+\s))((?iu:{'|'.join(dict.fromkeys(UNITS))})){_APART}"
_CAPITALISED = rf"\p{{Lu}}\p{{L}}*\p{{Ll}}\p{{L}}*{_APART}"
_NAME = rf"(?<=[\p{{Ll}}\p{{Nd}},;:)]\s{{1,3}}){_CAPITALISED}"
_MAYBE = rf"(?<![\p{{L}}\p{{N}}{NUMBER}{NAME}{UNIT}]){_CAPITALISED}"
_TOKEN = rf"{NUMBER}(?:\p{{Nd}}+(?:[.,:/]\p{{Nd}}+)*|\p{{L}}+)|[{NAME}{UNIT}{MAYBE}]?[\p{{L}}\p{{N}}]+"


def marked_tokens(text: Column) -> Column:
    """Lower-cased tokens of a text; numbers, units, names (capitalised inside a sentence) and other capitalised words start with their mark."""
    plain = F.translate(F.coalesce(text, F.lit("")), NUMBER + NAME + UNIT + MAYBE, "    ")
    numbers = F.regexp_replace(plain, _NUMBER, f"{NUMBER}$0")
    units = F.regexp_replace(numbers, _UNIT, f"$1 {UNIT}$2")
    names = F.regexp_replace(F.regexp_replace(units, _NAME, f"{NAME}$0"), _MAYBE, f"{MAYBE}$0")
    return F.regexp_extract_all(F.lower(names), F.lit(_TOKEN), F.lit(0))


def _is_slot(token: Column) -> Column:
    return token < F.lit("\u0004")


def vocabulary(tokens: DataFrame) -> DataFrame:
    """``(word, common)``: the words of the benchmark's ``(key, raw)``, and whether it writes them in lower case."""
    each = tokens.select(F.explode("raw").alias("t")).where(~F.col("t").startswith(NUMBER) & ~F.col("t").startswith(UNIT))
    bare = F.regexp_replace("t", f"^[{NAME}{MAYBE}]", "")
    return each.groupBy(bare.alias("word")).agg(F.max(F.col("t") > F.lit(MAYBE + "\U0010ffff")).alias("common"))


def settled(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """``(key, raw, plain)`` of ``(key, raw)``: capitalised words at a start are names unless they are common ``words``.

    ``plain`` has names as plain words, or null where the benchmark does not know the word.
    """
    each = tokens.select("key", F.posexplode("raw").alias("pos", "t"))
    # words without a mark meet nothing, and their key spreads them
    word = F.when(F.col("t").startswith(NAME) | F.col("t").startswith(MAYBE), F.substring("t", 2, 1_000_000)).otherwise(F.concat(F.lit(MAYBE), F.col("pos").cast("string")))
    each = each.withColumn("word", word).join(words, "word", "left")
    raw = F.when(F.col("t").startswith(MAYBE), F.when(F.col("common"), F.col("word")).otherwise(F.concat(F.lit(NAME), "word"))).otherwise(F.col("t"))
    each = each.select("key", "pos", raw.alias("raw"), F.col("common").isNotNull().alias("known"), "word")
    plain = F.when(F.col("raw").startswith(NAME), F.when(F.col("known"), F.col("word"))).otherwise(F.col("raw"))
    rows = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "raw", plain.alias("plain")))).alias("t"))
    return rows.select("key", F.col("t.raw").alias("raw"), F.col("t.plain").alias("plain"))


def template_windows(tokens: DataFrame, width: int = WINDOW, asked: bool = False) -> DataFrame:
    """``(key, pos, window, slots)`` of :func:`settled` tokens, for every window that holds two plain words or more.

    ``window`` hashes the template, ``slots`` has the marked values in order, separated by spaces. A window whose names
    are all known also comes with its names as plain words, so that copies with other case or line ends meet it. With
    ``asked`` there are ``counts``, the template's hash, and ``clue``, its longest pair of neighbouring plain words (or
    word, if there is no pair; null without); then the template alone must hold two plain words.
    """

    def form(t: Column) -> Column:
        return F.when(_is_slot(t), F.substring(t, 1, 1)).otherwise(t)

    shaped = tokens.where(F.size("raw") >= width).select(
        "key", "raw", F.transform("raw", form).alias("form"), F.exists("raw", _is_slot).alias("slotted"), "plain", F.transform("plain", form).alias("plain_form")
    )

    def part(name: str, i: Column) -> Column:
        return F.slice(name, i, width)

    def values(name: str, i: Column) -> Column:
        return F.when(F.col("slotted"), F.array_join(F.filter(part(name, i), _is_slot), " ")).otherwise(F.lit(""))

    def window(tokens: str, forms: str):
        def at(i: Column) -> Column:
            own = [F.xxhash64(part("form", i)).alias("counts"), values("raw", i).alias("full"), part("form", i).alias("words")] if asked else []
            return F.struct(i.alias("pos"), F.xxhash64(part(forms, i)).alias("window"), values(tokens, i).alias("slots"), *own)

        return at

    def named_known(i: Column) -> Column:
        return F.array_contains(part("form", i), NAME) & ~F.exists(part("plain", i), F.isnull)

    places = F.sequence(F.lit(1), F.size("raw") - width + 1)
    known = F.filter(places, named_known)
    windows = F.concat(F.transform(places, window("raw", "form")), F.transform(known, window("plain", "plain_form")))
    marks = "full" if asked else "slots"
    plain_words = width - F.when(F.col(marks) == "", 0).otherwise(F.size(F.split(marks, " ")))
    out = shaped.select("key", F.inline(windows)).where(plain_words >= 2)
    return out.withColumn("clue", _clue("words", width)).drop("full", "words") if asked else out


def _clue(words: str, width: int) -> Column:
    """Of the words of letters alone, the longest pair of neighbours, else the longest word. Sigmas, whose lower case depends on what follows, make no clue."""

    def usable(w: Column) -> Column:
        return w.rlike(r"^\p{L}+$") & ~w.rlike("[σς]")

    def at(j: Column) -> Column:
        one, two = F.get(words, j), F.get(words, j + 1)
        pair = F.when(usable(one) & usable(two), F.concat_ws(" ", one, two))
        return F.when(usable(one), F.struct(F.isnotnull(pair).alias("pair"), F.length(F.coalesce(pair, one)).alias("n"), F.coalesce(pair, one).alias("clue")))

    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), at))["clue"]


def clues(asked: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """``(clue)``: what every document that holds an item must have at least one of. A null clue rules nothing out."""
    each = asked.groupBy("item", "counts").agg(F.min("clue").alias("clue"))
    order = [F.desc_nulls_last(F.col("clue").contains(" ")), F.desc_nulls_last(F.length("clue")), "counts"]
    each = each.withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(*order))).join(sizes, F.col("item").eqNullSafe(F.col("of_item")))
    missed = F.floor(F.col("n_windows") * F.lit(1 - similarity) + F.lit(1e-6))
    return each.where(F.col("nth") <= missed + 1).select("clue").distinct()


def may_hold(text: Column, found: list[str]) -> Column:
    """Whether the letters-only words of a text, or two neighbouring ones, are among the clues."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")
    pairs = F.regexp_extract_all(plain, F.lit(r"(?<!\p{L})(?=(\p{L}+ \p{L}+))"), F.lit(1))
    kinds = ((F.split(plain, " "), [c for c in found if " " not in c]), (pairs, [c for c in found if " " in c]))
    tests = [F.exists(have, lambda w: w.isin(some)) for have, some in kinds if some]
    return F.lit(False) if not tests else tests[0] if len(tests) == 1 else tests[0] | tests[1]


def _consistent(met: DataFrame) -> DataFrame:
    """``(key, item, window)`` of the matches ``(key, item, shift, window, pairs)`` whose slots are consistent.

    Of the values that stand for one value of the item along an alignment, the one in most windows counts; equal counts
    prefer the value itself, then the smaller.
    """
    along = ["key", "item", "shift"]
    met = met.withColumn("equal", F.forall("pairs", lambda p: p["a"] == p["b"]))
    each = met.select(*along, "window", F.explode("pairs").alias("p")).groupBy(*along, "p").agg(F.countDistinct("window").alias("n"))
    best = F.min_by(F.col("p")["b"], F.struct((-F.col("n")).alias("n"), (F.col("p")["a"] != F.col("p")["b"]).alias("other"), F.col("p")["b"].alias("b")))
    chosen = each.groupBy(*along, F.col("p")["a"].alias("a")).agg(best.alias("b"))
    chosen = chosen.groupBy(*along).agg(F.map_from_entries(F.collect_list(F.struct("a", "b"))).alias("chosen"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"c.{c}")) for c in along]
    joined = met.alias("m").join(chosen.alias("c"), same, "left")
    right = F.col("m.equal") | F.forall("m.pairs", lambda p: F.get(F.map_values(F.map_filter("c.chosen", lambda a, _: a == p["a"])), F.lit(0)) == p["b"])
    return joined.where(right).select("m.key", "m.item", "m.window").distinct()


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
    broadcast_windows: int = 1_000_000,
    listed_clues: int = 100_000,
) -> DataFrame:
    """Documents that hold a benchmark item: ``(key, item_id, n_windows, n_found, similarity)``, one row per pair.

    ``similarity`` is the share of the item's distinct template windows found in the document with consistent slots. An
    item of two to four words is one window of that many. Whole texts are compared. Every row is judged by itself; of
    rows that share a key, or have none, the one that holds most of the item gives the figures. Items without a window
    that has two plain words can't be told from chance and match nothing; null and empty texts likewise. Items with
    equal ids are pooled, repeated rows change nothing, other columns are ignored, and an empty table on either side
    gives no rows. The benchmark's windows and words are broadcast only up to ``broadcast_windows`` rows (25 MB); beyond,
    both sides are shuffled. Up to ``listed_clues`` clues are written into the plan; beyond, or if a window has none,
    no document is ruled out beforehand, which is slower and finds the same.
    """

    def bounded(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= broadcast_windows else df

    raw = marked_tokens(F.col(f"`{item_text}`"))
    items = benchmark.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(f"`{item}`").alias("id")).alias("key"), raw.alias("raw"))
    items = written(items.where(F.size("raw") >= 2), "benchmark-tokens")
    words = bounded(written(vocabulary(items), "benchmark-words"))
    items = written(settled(items, words), "benchmark-settled")
    short = [r[0] for r in items.where(F.size("raw") < WINDOW).select(F.size("raw")).distinct().collect()]  # of three lengths at most
    asked = template_windows(items, WINDOW, True)
    for width in sorted(short):
        asked = asked.unionByName(template_windows(items.where(F.size("raw") == width), width, True))
    asked = asked.select(F.col("key")["id"].alias("item"), F.col("pos").alias("item_pos"), "window", F.col("slots").alias("item_slots"), "counts", "clue").distinct()
    asked = written(asked, "benchmark-windows")
    sizes = asked.groupBy(F.col("item").alias("of_item")).agg(F.countDistinct("counts").alias("n_windows"))

    found = [r[0] for r in clues(asked, sizes, similarity).limit(listed_clues + 1).collect()]
    possible = may_hold(F.col("text"), found) if None not in found and len(found) <= listed_clues else F.lit(True)
    row = F.struct(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("id")).alias("key")
    told = documents.select(row, F.col(f"`{text}`").alias("text")).where(possible).select("key", marked_tokens(F.col("text")).alias("raw"))
    told = settled(written(told, "possible-documents"), words)
    windows = template_windows(told)
    for width in short:
        windows = windows.unionByName(template_windows(told, width))
    met = windows.join(bounded(asked.drop("clue")), "window").select(
        "key",
        "item",
        F.col("counts").alias("window"),
        (F.col("pos") - F.col("item_pos")).alias("shift"),
        F.zip_with(F.split("item_slots", " "), F.split("slots", " "), lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("pairs"),
    )
    right = _consistent(written(met.distinct(), "window-matches"))
    counted = right.groupBy("key", "item").agg(F.count(F.lit(1)).alias("n_found"))
    counted = counted.groupBy(F.col("key")["id"].alias("key"), "item").agg(F.max("n_found").alias("n_found"))
    scored = counted.join(sizes, F.col("item").eqNullSafe(F.col("of_item"))).withColumn("similarity", F.col("n_found") / F.col("n_windows"))
    return scored.where(F.col("similarity") >= similarity).select(F.col("key").alias(key), F.col("item").alias("item_id"), "n_windows", "n_found", "similarity")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, broadcast_keys: int = 1_000_000) -> DataFrame:
    """The documents, all columns, without the rows that hold a benchmark item. See :func:`contaminated`.

    Rows are judged and dropped by a number of their own, whatever keys they share or lack.
    """
    rows, row = numbered(documents)
    bad = written(contaminated(rows, benchmark, row).select(row).distinct(), "contaminated")
    side = F.broadcast(bad) if bad.count() <= broadcast_keys else bad
    return rows.join(side, row, "left_anti").drop(row)


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """All documents against all benchmark items: the pairs where the document holds the item."""
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
