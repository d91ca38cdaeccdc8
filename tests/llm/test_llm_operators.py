"""Corpus operators against brute force, on hand-made edge tables and on the smallest given tables."""

import collections
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import chat_snapshots, decontaminate, language_model, main_text, nearest, sentencepiece_codec, simhash_dedup, token_files, toxicity, url_filters
from tablewright.llm.common import written
from tablewright.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
EDGE = [(1, "a b c d"), (2, None), (3, ""), (4, "  \t "), (5, "a b c d"), (5, "a b c d"), (None, "A B c\nd é 1"), (6, "x " * 30_000), (7, "it's  odd \n\n ▁ \0 end ")]
DOCS = "doc_id long, text string, n_tokens string, key string, window string, fp string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in EDGE], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    pick = sorted(got.columns)
    at = [want.columns.index(c) for c in pick]
    assert sorted(repr(tuple(r)) for r in got.select(pick).collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_url_filter_edges(spark):
    captures = spark.createDataFrame(
        [(1, "https://U:p@Sub.Bad.com:80/a/b?q", 5), (2, "http://bad.com", 10), (3, "bad.com/a", 15), (4, None, 5), (5, "http://bad.com", None), (6, "", 5), (6, "", 5), (7, "http://good.org/x/y", 7)],
        "id int, url string, fetched_at long",
    ).withColumn("blocked", F.lit("clash"))
    entries = spark.createDataFrame(
        [("l", "domain", "bad.com", "add", 3), ("l", "domain", "bad.com", "remove", 10), ("l", "domain", "bad.com", "add", 10), ("l", "domain", "bad.com", "remove", 12), ("m", "prefix", "good.org/x", "add", 7), ("m", "host", None, "add", 1)],
        "list_name string, kind string, pattern string, action string, at long",
    )
    got = {r["id"]: (r["blocked"], r["match_key"], r["match_since"]) for r in url_filters.judge_captures(captures, entries, period=4).collect()}
    assert got == {1: (True, "domain bad.com", 3), 2: (True, "domain bad.com", 10), 3: (False, None, None), 4: (None, None, None), 5: (None, None, None), 6: (False, None, None), 7: (True, "prefix good.org/x", 7)}
    assert url_filters.judge_captures(captures, entries).count() == 8
    assert url_filters.judge_captures(captures.limit(0), entries).count() == 0
    assert url_filters.judge_captures(captures, entries.limit(0)).where("blocked").count() == 0


def test_decontamination_slots(spark, empty):
    item = "A train leaves Paris at 40 km per hour and 40 minutes later Anna sees the train pass with 3 cars"
    docs = spark.createDataFrame(
        [
            (1, f"Intro text here. {item} and more."),
            (2, "before " + item.replace("40", "55").replace("3 cars", "9 cars").replace("Anna", "Berta")),
            (3, item.replace("40 km", "55 km")),  # one value becomes two: not the same question
            (4, "Nothing of the kind is in here at all, not 40 km."),
            (5, None),
            (6, ""),
            (None, item),
        ],
        "doc_id long, text string",
    ).withColumn("item", F.lit("clash"))
    items = spark.createDataFrame([(7, item), (7, item), (8, "too short"), (9, None), (10, "1 2 3 4 5 6 7 8")], "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 7), (2, 7), (None, 7)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items, broadcast_windows=0).collect()} == got
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_with_single_contradictions(spark):
    long = " ".join(["word" + "abcdefghijklmnopqrstuvwxyz"[i % 26] + "xyz"[i // 26] for i in range(42)]).split()
    long = " ".join([*long[:10], "2", *long[10:30], "2", *long[30:]])
    pens = "there were 3 red pens and 4 blue pens in a big box of wood today"
    docs = spark.createDataFrame(
        [(1, "2 ".join([*long.split("2 ")[:2], ""])[:-2] + "3 " + long.split("2 ")[2]), (2, pens.replace("3", "5").replace("4", "5")), (3, "nothing")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(7, long), (8, pens)], "item_id int, text string")
    got = {r["doc_id"]: (r["item_id"], r["n_windows"], r["n_found"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got[1] == (7, 40, 35) and got[2][0] == 8 and set(got) == {1, 2}


def test_decontamination_judges_rows(spark):
    item = "we counted 3 red pens and 4 blue pens in a big box of wood"
    other = item.replace("3", "7")
    docs = spark.createDataFrame([(None, item), (None, "a clean text"), (1, "clean too"), (1, other), (1, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id int, text string")
    assert sorted(r["text"] for r in decontaminate.drop_contaminated(docs, items).collect()) == ["a clean text", "clean too"]
    assert {(r["doc_id"], r["n_found"]) for r in decontaminate.contaminated(docs, items).collect()} == {(None, 11), (1, 11)}


def test_decontamination_of_number_words_units_and_short_items(spark):
    items = spark.createDataFrame(
        [
            (1, "He pours three liters of water and then two liters of milk into one large bowl"),
            (2, "Der Zug fährt 80 Kilometer in einer Stunde und braucht danach drei Stunden bis zum Ziel"),
            (3, "drei plus vier macht zusammen eine schöne Zahl"),
            (4, "quite short items count"),
            (5, "a b"),
            (6, "42"),
        ],
        "item_id int, text string",
    )
    docs = spark.createDataFrame(
        [
            (1, "He pours seven liters of water and then four liters of milk into one large bowl"),
            (2, "Der Zug fährt 95 km in einer Stunde und braucht danach 2 Stunden bis zum Ziel"),
            (3, "acht plus fünf macht zusammen eine schöne Zahl"),
            (4, "so Quite short\nitems count here"),
            (5, "quite short items don't count"),
            (6, "42"),
        ],
        "doc_id long, text string",
    )
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(i, i) for i in (1, 2, 3, 4)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items, listed_clues=0).collect()} == got


def test_clues_rule_out_no_match(spark, documents):
    """The documents that clues leave hold all that is found without them, also with edited words."""
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    rng = np.random.default_rng(4)
    texts = [r["text"] for r in items.collect()]
    edited = []
    for i, t in enumerate(texts * 6):
        part = t.split(" ")
        for at in rng.choice(len(part), min(len(part), 1 + i % 3), replace=False):
            part[at] = rng.choice(["17", "Berta", "word", part[at].upper(), part[at].title()])
        edited.append((10_000 + i, "before " + " ".join(part)))
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(edited, "doc_id long, text string"))
    fast, slow = ({tuple(r) for r in decontaminate.contaminated(docs, items, similarity=s, listed_clues=n).collect()} for s, n in ((0.5, 100_000), (0.5, 0)))
    assert fast == slow and len(fast) > len(texts)


def test_decontamination_of_names_at_any_place(spark):
    item = "Tom has 3 apples. Tom buys 4 more apples. How many apples does Tom have now?"
    docs = spark.createDataFrame(
        [
            (1, item.replace("Tom", "Mary").replace("3", "8").replace("4", "6")),
            (2, item.lower()),
            (3, item.replace(". ", ".\n").replace("does ", "does\n")),
            (4, "Q: " + item.replace("Tom", "McAdam").replace("does ", "does  ")),
            (5, "Tom has no apples. Anna buys 4 pears. How many pears does she have?"),
        ],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(7, item)], "item_id int, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, items).collect()} == {1, 2, 3, 4}


def test_decontamination_against_brute_force(spark, documents):
    import re

    def grams(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return set(zip(w, w[1:], w[2:], w[3:], w[4:]))

    items = [(r["item_id"], grams(r["text"])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = {(r["doc_id"], i) for r in documents.collect() for g in [grams(r["text"])] for i, q in items if q and len(q & g) / len(q) >= 0.8}
    assert {(r["doc_id"], r["item_id"]) for r in QUERIES["op2_decontaminate"](spark, FOLDER).collect()} == want


def test_elias_fano():
    rng = np.random.default_rng(0)
    for values in ([], [0], [5, 5, 5], [0, 2**40], np.sort(rng.integers(0, 10**6, 5000)), np.sort(rng.integers(0, 2**63, 3000, dtype=np.uint64))):
        values = np.array(values, np.uint64)
        ef = language_model.EliasFano.build(values)
        assert (ef.access(np.arange(len(values))) == values).all()
        found = ef.find(values)
        assert len(values) == 0 or (values[found] == values).all()
        other = np.setdiff1d(np.array([1, 3, 77, 2**39, 2**62], np.uint64), values)
        assert (ef.find(other) == -1).all()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_against_brute_force(edge, documents, order):
    docs = documents.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    got = language_model.score(docs, language_model.train(docs.where("doc_id % 3 = 0"), order=order)).toPandas()
    rows = [(r["doc_id"], ["\n", *words(r["text"]), "\n"]) for r in docs.collect()]
    known = [w for i, w in rows if i is not None and i % 3 == 0]
    count = collections.Counter(w for ws in known for w in ws[1:])
    n, v, d = sum(count.values()), len(count), language_model.DISCOUNT
    grams = [collections.Counter(tuple(ws[i : i + k]) for ws in known for i in range(len(ws) - k + 1)) for k in range(2, order + 1)]
    after = [collections.Counter(g[:-1] for g in c) for c in grams]

    def total(context):
        return count[context[0]] if len(context) == 1 else grams[len(context) - 2][context]

    def p(context, w):
        if not context:
            return (max(count[w] - 1, 0) + v / (v + 1)) / n
        low = p(context[1:], w)
        c = total(context)
        if not c:
            return low
        k = len(context) - 1
        rest = d * after[k][context] / c if after[k][context] else 1.0
        return max(grams[k][(*context, w)] - d, 0) / c + rest * low

    want = []
    for i, ws in rows:
        s = sum(math.log10(p(tuple(ws[max(0, j - order + 1) : j]), ws[j])) for j in range(1, len(ws)))
        want.append((len(ws) - 1, sum(count[w] > 0 for w in ws[1:]), sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws[1:]), s))
    have = sorted(zip(got.n_tokens, got.n_known, got.base_score, got.score))
    for a, b in zip(have, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9) and abs(a[3] - b[3]) < 5e-4 * a[0]
    assert set(got.train_tokens) == {n}


def test_language_model_of_nothing(edge, empty):
    trie = language_model.train(empty)
    assert {r["score"] for r in language_model.score(edge, trie).collect()} == {0.0}
    assert language_model.score(empty, trie).count() == 0


def test_snapshots(spark):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 1, "assistant", "yo"), (4, 0, "user", "other"), (None, 0, "user", "x"), (5, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("k", F.lit("clash"))
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_snapshots.render_conversations(df).collect()}
    said = "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert got == {2: (2, 2, said), 4: (1, 1, "<|im_start|>user\nother<|im_end|>\n"), 5: (1, 1, "<|im_start|>\n<|im_end|>\n")}
    assert chat_snapshots.render_conversations(df.limit(0)).count() == 0


def test_toxicity(spark, edge, empty):
    docs = [(i, f"they are {'awful scum' if i % 2 else 'good people'} {'muslim' if i % 2 else 'friend'} number{i % 7}") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs] + [(None, 1), (999, None)], "doc_id long, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sample = toxicity.labelled_sample(df, labels, F.lit(True))
    free, held = toxicity.fit(sample, penalty=0.0), toxicity.fit(sample, penalty=50.0)

    def moved(model):
        a, b = model.score_all(["a muslim neighbour", "a christian neighbour"], {})
        return abs(a - b)

    assert moved(held) < 0.25 * moved(free)
    bad, good = held.score_all(["they are awful scum", "they are good people"], {})
    assert bad > 0.5 > good
    scored = toxicity.with_score(edge, held)
    assert scored.count() == len(EDGE) and scored.where("_toxicity BETWEEN 0 AND 1").count() == len(EDGE)
    assert toxicity.drop_toxic(edge, held).columns == edge.columns
    assert toxicity.with_score(empty, held).count() == 0
    assert toxicity.fit(toxicity.labelled_sample(empty, labels, F.lit(True))).score_all(["x", None], {})[0] < 0.3


def test_toxicity_held_out(spark):
    got = QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    labels = dict(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic").collect())
    held = got[got.held_out & got.doc_id.isin(labels)]
    truth = held.doc_id.map(labels)
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    hit = ((held.predicted == 1) & (truth == 1)).sum()
    assert hit / (truth == 1).sum() > 0.85 and hit / (held.predicted == 1).sum() > 0.85


def page(body):
    return f"<html><head><title>t</title><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_main_text_markup():
    kept = main_text.parse(page("<nav>menu</nav><article><header><h1>Head&amp;line</h1><p>by me</p></header><p>One\n two&nbsp;<b>x<br><p>Three<div class='ad'>buy</div><section id=comments>nice</section></article><aside>s</aside><footer>f</footer>"))
    assert kept[0] == ["Head&line", "One two x", "Three"]
    assert main_text.parse(None) == ([], [], []) and main_text.parse("") == ([], [], [])
    assert main_text.parse("plain < text")[1] == ["plain < text"]


def test_attributes_are_names_with_values():
    for attributes in ('style="overflow:hidden"', 'aria-hidden="false"', 'title="the hidden valley"', 'data-x="class=ad id=comments"', "data-hidden", "title='role=navigation'"):
        assert main_text.parse(page(f"<article {attributes}><p>All of it stays.</article>"))[0] == ["All of it stays."], attributes
    inside = '<article><h2 id="search-results">Results</h2><section id="related-work"><p>We follow others.</p></section><p id="share">Shares rose.<td id="ads">cell</td></article>'
    assert main_text.parse(page(inside))[0] == ["Results", "We follow others.", "Shares rose.", "cell"]
    for gone in ('<div hidden>x</div>', '<div HIDDEN="">x</div>', '<div style="color:red; display : none">x</div>', '<p aria-hidden="true">x</p>', '<div id="comments">x</div>', '<section id=comments>x</section>', "<div class='share-bar'>x</div>", "<div role=' navigation '>x</div>"):
        assert main_text.parse(page(f"<article><p>Kept.</p>{gone}</article>"))[0] == ["Kept."], gone


def test_main_text_of_hosts(spark):
    menu = "<div>Home and other places to go on this site today</div>"
    rows = [(i, f"http://h.com/{i}", page(f"{menu}<div>unique words of page number {i} stand here alone</div>")) for i in range(6)]
    rows += [(10, "http://h.com/10", rows[0][2]), (11, "http://solo.com/", rows[0][2]), (12, None, None), (None, "http://h.com/9", ""), (13, "http://h.com/13", page("<article>Whole</article>" + menu))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    for size in (1_000_000, 20):  # one group, and one for nearly every page
        got = {r["page_id"]: r["text"] for r in main_text.main_text(df, group_bytes=size).collect()}
        assert all(got[i] == f"unique words of page number {i} stand here alone" for i in range(6))
        assert got[10] == got[0] and got[13] == "Whole" and got[12] == "" and got[None] == ""
        assert got[11].startswith("Home and other places")
    assert main_text.main_text(df.limit(0)).count() == 0


def nearest_by_hand(rows, k, by_key):
    """Sorted lists of (score, id) for each query row with an id divisible by 20, from exact products of doubles."""
    fit = [(i, n, np.array(v, np.float64)) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = collections.Counter()
    for i, n, q in fit:
        if i % 20 == 0:
            with np.errstate(over="ignore", invalid="ignore"):
                told = [(np.nan_to_num(np.einsum("i,i->", q, x), nan=-np.inf, posinf=np.inf, neginf=-np.inf), j, m) for j, m, x in fit if len(x) == len(q) and (j != i if by_key else m != n)]
            best = sorted(told, key=lambda t: (-t[0], t[1], t[2]))[:k]
            out[i, tuple((float(f"{s:.9g}"), j) for s, j, _ in best)] += 1
    return out


def nearest_found(df):
    """The lists of a result; rows of queries that share an id are told apart by the order in which ranks begin anew."""
    lists = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in df.collect():
        lists[r["query_id"]][r["rank"]].append((float(f"{r['score']:.9g}"), r["vec_id"]))
    return lists


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n, kinds in ((0, 1), (1, 1), (40, 1), (400, 2), (2000, 50)):
        tokens = rng.integers(0, kinds, n).astype(np.uint64)
        order, shared = main_text.suffix_array(tokens)
        suffixes = [tuple(tokens[i:].tolist()) for i in order]
        assert suffixes == sorted(suffixes) and sorted(order.tolist()) == list(range(n))
        for k in range(1, n):
            a, b = suffixes[k - 1], suffixes[k]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[k] == min(same, main_text.LONG)


def test_repeats_in_articles(spark):
    """What most pages of a host show inside their articles goes; passages that some of them share stay."""
    passage = "a passage of many words that three of the twelve pages quote in full and nobody may drop from them"
    rows = []
    for i in range(12):
        quote = f"<p>{passage}</p>" if i % 4 == 0 else ""
        rows.append((i, f"http://h.com/{i}", page(f"<article><p>Page {i} has its own words about number {i}.</p><p>Subscribe to our newsletter</p>{quote}<p>The end of {i}.</p></article>")))
    rows += [(50, "http://h.com/50", rows[0][2]), (60, "http://few.com/1", rows[1][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for size in (1_000_000, 300):
        got = {r["page_id"]: r["text"].split("\n") for r in main_text.main_text(df, group_bytes=size).collect()}
        for i in range(12):
            assert got[i] == [f"Page {i} has its own words about number {i}.", *([passage] if i % 4 == 0 else []), f"The end of {i}."]
        assert got[50] == got[0] and "Subscribe to our newsletter" in got[60]


def test_repeated_runs_of_open_pages_by_hand(spark):
    """Against all windows of eight tokens, counted over distinct pages."""
    rng = np.random.default_rng(9)
    shared = [" ".join(rng.choice(["x", "y", "z", "w", "v"], 12)) for _ in range(6)]
    rows = []
    for i in range(25):
        blocks = [f"own {i} " + " ".join(f"u{i}x{k}" for k in range(int(rng.integers(3, 12)))) for _ in range(3)]
        blocks += [str(s) for s in rng.choice(shared, 2)]
        rng.shuffle(blocks)
        rows.append((i, "http://h.com/", "<body>" + "".join(f"<div>{b}</div>" for b in blocks) + "</body>"))
    rows += rows[:4]
    streams = {i: ["\n", *" \n ".join(main_text.parse(h)[1]).split(" "), "\n"] for i, _, h in rows}
    windows = collections.Counter(w for t in {tuple(t) for t in streams.values()} for w in {t[k : k + 8] for k in range(len(t) - 7)})

    def left(tokens):
        gone = [any(windows.get(tuple(tokens[k : k + 8]), 0) >= 3 for k in range(max(0, i - 7), i + 1) if k + 8 <= len(tokens)) for i in range(len(tokens))]
        out, block = [], []
        for t, g in [*zip(tokens[1:], gone[1:])]:
            if t != "\n":
                block.append((t, g))
                continue
            kept, i = [], 0
            while i < len(block):
                j = i
                while j < len(block) and block[j][1] == block[i][1]:
                    j += 1
                if not block[i][1] or j - i < 8 and not all(x for _, x in block):
                    kept += [w for w, _ in block[i:j]]
                i = j
            if kept:
                out.append(" ".join(kept))
            block = []
        return "\n".join(out)

    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for size in (1_000_000, 400):
        for r in main_text.main_text(df, group_bytes=size).collect():
            assert r["text"] == left(streams[r["page_id"]])


def test_nearest(spark):
    rng = np.random.default_rng(1)
    base = np.round(rng.normal(size=(300, 8)), 1)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(301, base[0].tolist()), (301, base[0].tolist()), (302, [9.0] * 8), (302, [-9.0] * 8), (404, [1.0] * 3), (405, [2.0] * 3), (400, [1.0, 2.0, 3.0])]
    rows += [(400, [0.0] * 8), (401, None), (402, [float("nan")] * 8), (403, [None] + [1.0] * 7), (406, []), (407, [float("inf")] * 8), (None, [1.0] * 8)]
    # tiny, huge and subnormal vectors take part; so do products that overflow, or run to both infinities
    rows += [(500, [5e-324] + [0.0] * 7), (501, [1e-322] * 8), (520, [1e200] * 8), (521, [1e200, -1e200] * 4), (522, [-1e300] * 8), (540, [1e-200] * 8), (523, [1.7e308] * 8)]
    df = spark.createDataFrame([(i, v, n) for n, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, row long").withColumn("key", F.lit("clash")).repartition(3)
    for k, row in ((5, "row"), (20, None), (400, "row")):
        got = nearest_found(nearest.nearest_neighbours(df.where("vec_id % 20 = 0"), df, k=k, row=row, query_block=4, candidate_block=64))
        for i, best in nearest_by_hand(rows, k, row is None):
            assert [got[i][n] for n in range(1, k + 1) if n in got[i]] == [[b] for b in best], i
        assert set(got) == {i for i, _ in nearest_by_hand(rows, k, row is None)}
    assert nearest.nearest_neighbours(df.limit(0), df).count() == 0
    assert nearest.nearest_neighbours(df, df.limit(0), row="row").count() == 0


def test_nearest_with_repeated_ids(spark):
    """Rows that share an id are queries and candidates of their own."""
    rows = [(20, [0.5, 0.5]), (20, [9.0, 9.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (1, [0.0, 2.0])]
    df = spark.createDataFrame([(i, v, n) for n, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, row long")
    got = collections.Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest.nearest_neighbours(df.where("vec_id = 20"), df, k=2, row="row").collect())
    # [9, 9] meets [0, 2] with 18 and then one of the others with 9; both [0.5, 0.5] meet it with 9, then [0, 2] with 1
    assert got == {(20, 1, 1, 18.0): 1, (20, 2, 1, 9.0): 1, (20, 1, 20, 9.0): 2, (20, 2, 1, 1.0): 2}
    assert nearest.nearest_neighbours(df.where("vec_id = 20"), df, k=9).groupBy("query_id").count().first()["count"] == 6


def test_many_equal_ids_do_not_hide_neighbours(spark):
    """A tile of more candidates than are asked for, one of them tiny: the case in which rounding has no step."""
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 2)))] + [(99, [1e-322, 0.0])]
    df = spark.createDataFrame([(i, v, n) for n, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, row long")
    got = nearest_found(nearest.nearest_neighbours(df.where("vec_id % 20 = 0"), df, k=20, row="row"))
    for i, best in nearest_by_hand(rows, 20, False):
        assert [got[i][n][0] for n in range(1, 21)] == list(best)


def test_simhash_against_brute_force(edge, empty, documents):
    docs = documents.select("doc_id", "text").unionByName(edge.select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    rows = [(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash_dedup.near_duplicates(docs, shard_size=3).collect()]
    assert sorted(rows, key=str) == sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash_dedup.near_duplicates(docs).collect()), key=str)
    codes = sorted({f for _, f, _ in rows})
    up = {f: f for f in codes}

    def find(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                up[find(b)] = find(a)
    least = {}
    for i, f, _ in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    assert all(c == least.get(find(f)) for _, f, c in rows)
    # one of each component stays: the smallest id, none comes last; texts without words are copies of each other
    prints = [simhash_dedup.fingerprint(words(t)) & (2**64 - 1) for _, t in EDGE]
    best = {}
    for (k, _), f in zip(EDGE, prints):
        best[find(f)] = min(best.get(find(f), (True, 0)), (k is None, k or 0))
    kept = simhash_dedup.keep_one_of_each(edge)
    assert kept.columns == edge.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(None if last else k) for last, k in best.values())
    assert simhash_dedup.near_duplicates(empty).count() == 0


def test_near_copies_against_brute_force(spark, documents):
    from tablewright.llm import near_copies

    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 120)]
    near = [(50_000, " ".join(base))]
    for i in range(1, 60):  # one to four changed words: similarity 0.92 down to 0.7 with the base, less among each other
        copy = list(base)
        for at in rng.choice(120, 1 + i % 4, replace=False):
            copy[at] = f"x{i}"
        near.append((50_000 + i, " ".join(copy)))
    near += [(None, near[0][1]), (None, "alone and without a key in the table"), (7, "same key other text of six words"), (7, "quite another text under one key again")]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = [set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)} - {()} for w in (words(t) for _, t in rows)]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or min(len(a), len(sets[j])) > 0 and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (key is None, key or 0))
    want = sorted(str(None if last else key) for last, key in least.values())
    assert sorted(str(r["doc_id"]) for r in near_copies.keep_one_of_each(docs).collect()) == want
    numbered = written(docs.select(F.monotonically_increasing_id().alias("row"), "text"), "rows")
    assert near_copies.components(numbered, block_nodes=7).select("root").distinct().count() == len(want)
    assert near_copies.components(numbered.limit(0)).count() == 0


def test_bk_tree():
    rng = np.random.default_rng(2)
    codes = np.unique(np.concatenate([rng.integers(0, 2**10, 300, dtype=np.uint64), rng.integers(0, 2**63, 300, dtype=np.uint64)]))
    rng.shuffle(codes)
    got = {(int(a), int(b)) for x, y in simhash_dedup.within_radius(codes, 2) for a, b in zip(x, y)}
    assert got == {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 2}


def test_sentencepiece_matches_the_library(edge, empty, documents):
    import sentencepiece

    path = sentencepiece_codec.public_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = documents.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    texts = [r["text"] or "" for r in docs.collect()]
    encoded = sentencepiece_codec.encode(docs, path)
    rows = encoded.collect()
    assert sorted(r["ids"] for r in rows) == sorted(library.encode(texts)) and all(r["restored"] for r in rows)
    assert sorted(r["text"] for r in sentencepiece_codec.decode(encoded, path).collect()) == sorted(t.replace("▁", " ") for t in texts)
    assert sentencepiece_codec.encode(empty, path).count() == 0


def test_token_files(edge, empty, documents):
    from tokenizers import Tokenizer

    path = token_files.public_tokenizer()
    whole = Tokenizer.from_file(path)
    docs = documents.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    got = token_files.read_token_files(token_files.write_token_files(docs, path, shard_tokens=5000)).orderBy("start").collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, collections.Counter()
    for key, text in rows:
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want[key, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == [k for k, _ in rows]
    assert token_files.read_token_files(token_files.write_token_files(empty, path)).count() == 0


def test_chunks_encode_as_whole_texts():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    path, draw = token_files.public_tokenizer(), random.Random(1)
    letters = ["a", "B", "1", " ", "\n", "\t", "'", "s", ".", ",", "é", " ", "\x1c", "\u3000", "😀", "\r", "<|endoftext|>", "\u200d", "\0"]
    texts = [None, "", *("".join(draw.choices(letters, k=draw.randint(0, 14))) for _ in range(20_000))]
    want = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    got = token_files.ChunkEncoder(path, cached=1000)
    for at in range(0, len(texts), 5000):
        part = pa.array(texts).slice(at, 5000)
        assert [x.tolist() for x in got.encode(part)] == [w.ids for w in want[at : at + 5000]]


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(1, np.uint32), rng.integers(0, 9, 500).astype(np.uint32), rng.integers(0, 70_000, 300).astype(np.uint32)):
        m = token_files.WaveletMatrix.from_bytes(token_files.WaveletMatrix.build(ids, np.array([len(ids)])).to_bytes())
        assert (m.all() == ids).all()
        assert [m.access(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()
        for t in (int(ids[0]), 5, 10**6):
            places = np.flatnonzero(ids == t).tolist()
            assert m.count(t) == len(places) and m.count(t, 3, len(ids) // 2 + 3) == sum(3 <= p < len(ids) // 2 + 3 for p in places)
            assert [m.find(t, i) for i in range(len(places))] == places and m.find(t, len(places)) == -1


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns
        assert not after.join(docs, "doc_id", "left_anti").limit(1).count()
    assert corpus_pipeline.run(spark, FOLDER).where("NOT restored").count() == 0


CLASHES = ["_row", "_ROW_", "_toxicity", "fp", "row", "key", "root", "kept", "bad", "component_id", "window", "item", "url", "t"]


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty and repeated rows, extra columns with clashing names, and empty tables through every stage."""
    import corpus_pipeline

    item = "we counted 3 red pens and 4 blue pens in a big box of wood today"
    texts = [(1, "a clean text of some words that stand here"), (1, "a clean text of some words that stand here"), (2, None), (None, ""), (None, item), (3, f"so {item} it is"), (4, "other words than those of all the rest"), (None, "other words than those of all the rest")]
    extra = ", ".join(f"`{c}` int" for c in CLASHES)
    docs = spark.createDataFrame([(k, t, "en", None, 1, *range(len(CLASHES))) for k, t in texts], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item), (8, None)], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {"toxicity": 8, "near_duplicates": 5, "decontamination": 6}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and after.count() == left[name]
        assert {tuple(r[5:]) for r in after.collect()} == {tuple(range(len(CLASHES)))}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    kept = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4"]


def test_columns_with_the_names_used_inside(spark):
    captures = spark.createDataFrame([(1, "http://bad.com/a", 5, "mine", "its", 7)], "id int, url string, fetched_at long, _v_url string, `_c.t` string, t int")
    entries = spark.createDataFrame([("l", "host", "bad.com", "add", 3)], "list_name string, kind string, pattern string, action string, at long")
    row = url_filters.judge_captures(captures, entries).first()
    assert (row["blocked"], row["_v_url"], row["_c.t"], row["t"]) == (True, "mine", "its", 7)
