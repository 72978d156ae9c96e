"""Each operator against a brute-force version: driver tables, and rows with nulls, copies and clashing names."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cuelab.llm import bpe, exact_dedup, golay, html_text, packing, quality, queries, simhash, token_counts, token_files, toxicity, url_rules
from cuelab.llm.encode import Encoder
from cuelab.workspace import fresh_path

SF = "/root/testdata/sf0.001"
WHITE = re.compile(r"[\x20\x09-\x0D]+")
LONG = "Lorem ipsum, dolor\n" * 4000
TEXTS = [
    (5, None), (3, ""), (3, ""), (1, "a b  c\td"), (2, "a b c d"), (None, "a b c d"), (7, " \n "), (8, "<|endoftext|> x <|startoftext|>y"),
    (9, "naïve café ﬁ İstanbul ΣΑΣ 日本語 \u2003x 1234 ½ it's it'S"), (10, LONG), (11, LONG), (12, "A  \n  b   "), (13, "x" * 5000), (2, "a b c d"),
]
KIND = "doc_id bigint, text string, lang string, source string, kept string, len int, row_tag int, fp string, n_words string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "s", "k", 1, 2, "f", None) for i, t in TEXTS], KIND)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module", params=["odd", "docs", "none"])
def table(request, spark):
    return spark.createDataFrame([], KIND) if request.param == "none" else request.getfixturevalue(request.param)


def texts(table):
    return [(r[0], r[1] or "") for r in table.select("doc_id", "text").collect()]


def same(df, want):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_token_counts(table):
    t = Tokenizer.from_file(queries.WORD_BPE)
    want = [(i, len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in texts(table)]
    same(token_counts.token_counts(table, queries.WORD_BPE), want)


def letters():
    return [chr(c) for c in [*range(0x3000), *range(0xA640, 0xAC00), *range(0x3000, 0x20000, 37)] if not 0xD800 <= c < 0xE000]


def test_encoders_split_as_the_libraries_do():
    data = open(queries.BYTE_BPE, "rb").read()
    whole, part = Tokenizer.from_buffer(data), Encoder(data)
    words = open(queries.WORD_BPE, "rb").read()
    counter, count = token_counts.Counter(words, token_counts.whole_tokens(words)), Tokenizer.from_buffer(words)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    replayer = bpe.Replayer(open(queries.RANKS, "rb").read(), P.PATTERN)
    assert part.cut and counter.pattern
    sample = [f"a{x} {x}b {x} c{x}1{x}  {x}Q  {x}{x} it's{x}'s .{x}! \n{x} \n{x}.\nB{x}!!" for x in letters()]
    assert [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(sample, add_special_tokens=False)] == part.ids(sample)
    assert [len(e.ids) for e in count.encode_batch(sample, add_special_tokens=False)] == counter.count(sample)
    assert [np.array(tik.encode_ordinary(x), "<u4").tobytes() for x in sample] == replayer.ids(sample)


def test_encoder_on_odd_texts_with_a_small_store(monkeypatch):
    monkeypatch.setattr(Encoder, "MOST_STRETCHES", 50)
    monkeypatch.setattr(Encoder, "MOST_CHARS", 400)
    data = open(queries.BYTE_BPE, "rb").read()
    whole, part, draw = Tokenizer.from_buffer(data), Encoder(data), random.Random(3)
    bits = [" ", " ", " ", "a", "the", "\n", "\n", "\t", "<|endoftext|>", "<", ".", ",", "$$$", "'s", "é", "1", "\xa0", "᠎", "\r", "日本", "😀", "<|", "\x00", "\x85"]
    sample = ["".join(draw.choices(bits, k=draw.randrange(14))) for _ in range(5000)]
    # a stretch of thousands of lines, white space alone, one very long word
    sample += ["", " ", "  ", "a\n" * 5000, "a,\n" * 4000, "\n" * 3000 + "x", " " * 50_000, "x" * 100_000, "ab, " * 500_000]
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(sample, add_special_tokens=False)]
    assert want == part.ids(sample)
    assert want == [x for k in range(0, len(sample), 37) for x in part.ids(sample[k : k + 37])]


def test_encoder_gathers_stretches_by_number(monkeypatch):
    data = open(queries.BYTE_BPE, "rb").read()
    whole, part, draw = Tokenizer.from_buffer(data), Encoder(data), random.Random(5)
    learnt = []
    monkeypatch.setattr(part, "_learn", lambda *x, learn=part._learn: learnt.append(len(x[1])) or learn(*x))
    part.ids(["ab cd " * 250_000, "ab cd. " * 200_000])
    assert learnt == [1, 4]  # distinct stretches: at the start of a text, and after a space
    monkeypatch.setattr(Encoder, "BLOCK_CHARS", 60)
    bits = [" ", " ", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u180e", "\u3000", "a", "é", "b.", "<", "12", "\U0001f600", ""]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 30))) for _ in range(1500)] + ["", " ", "  ", " a", "a ", "a  b"]
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert part.ids(texts) == want


def test_replay_waits_for_lower_ranks():
    ranks = {bytes((i,)): i for i in range(256)} | {b"bc": 300, b"abc": 260, b"abcd": 256, b"cd": 301}
    tik = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    words = [b"abcdabcdbc", b"bcbcabc", b"", b"cdcdcd"]
    assert bpe.replay(words, ranks) == [tik.encode_ordinary(w.decode()) for w in words]


def test_byte_bpe(spark, table):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.with_ids(table.withColumnRenamed("len", "ids") if "len" in table.columns else table, queries.RANKS, P.PATTERN)
    name = coded.columns[-1]
    back = coded.select("doc_id", name, bpe.decoded(spark, coded[name], queries.RANKS).alias("b"))
    got = sorted(((r[0], list(r[1]), bytes(r[2])) for r in back.collect()), key=repr)
    want = sorted(((i, tik.encode_ordinary(x), x.encode()) for i, x in texts(table)), key=repr)
    assert got == want
    both = table.select("doc_id", bpe.round_trip(spark, F.coalesce("text", F.lit("")), queries.RANKS, P.PATTERN).alias("b"))
    assert sorted(((r[0], list(r[1]), bytes(r[2])) for r in both.select("doc_id", "b.ids", "b.bytes").collect()), key=repr) == want


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 300, 5000):
        counts = Counter(rng.integers(1, 65, n).tolist())
        fillings = packing.plan(counts, 64)
        used = Counter()
        for lengths, k in fillings:
            assert sum(lengths) <= 64 and k > 0
            used.update({x: k * c for x, c in Counter(lengths).items()})
        assert used == counts
        assert sum(k for _, k in fillings) <= max(-(-sum(x * k for x, k in counts.items()) // 64), sum(k for x, k in counts.items() if x > 32)) * 1.05 + 1


def test_packing(table):
    t = Tokenizer.from_file(queries.BYTE_BPE)
    want, inside = [], defaultdict(list)
    for i, x in texts(table):
        ids = t.encode(x, add_special_tokens=False).ids + [2]
        at, to, k = 0, len(ids) % 64 or 64, 0
        while at < len(ids):
            want.append((i, k, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())))
            at, to, k = to, to + 64, k + 1
    got = packing.pack(table, queries.BYTE_BPE, capacity=64, with_ids=True).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    for r in got:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in inside.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64


def test_toxicity_learns_and_holds_out(spark):
    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gamma", "delta", "house", "tree", "river", "stone"]
    rows, marks = [], []
    for i in range(400):
        body = rng.choice(words, 80).tolist()
        toxic = i % 5 == 0
        if toxic:
            body[10] = ("vile", "rotten")[i % 2]
        rows.append((i, " ".join(body)))
        marks.append((i, int(toxic)))
    rows += [(None, None), (1000, ""), (0, rows[0][1])]
    marks += [(None, 1), (7, None), (5, 1), (5, 0)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    truth = dict(marks[:400])
    for r in got:
        if r["doc_id"] in truth:
            assert r["predicted"] == truth[r["doc_id"]] and 0 <= r["score"] <= 1
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        else:
            assert r["predicted"] == 0 and r["held_out"] is (r["doc_id"] is not None and zlib.crc32(b"1000") % 4 == 2)
    none = toxicity.score_toxicity(docs, labels.limit(0))
    assert {tuple(r) for r in none.select("score", "predicted").collect()} == {(0.0, 0)}
    assert toxicity.drop_toxic(docs, labels).count() == 323 - 1  # the repeated toxic row goes too


def test_toxicity_counts_all_training_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_TOXIC", 40)  # of the logistic curve only
    monkeypatch.setattr(toxicity, "MOST_ORDINARY", 80)
    rng = np.random.default_rng(6)
    rows, truth = [], {}
    for i in range(900):
        body = [f"w{k}" for k in rng.integers(0, 30, 60)]
        truth[i] = int(i % 5 == 0)
        if truth[i]:
            body[30] = f"bad{i // 5 % 12}"  # each in some 11 training texts, in under 5 of the sample
        rows.append((i, " ".join(body)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = toxicity.score_toxicity(docs, spark.createDataFrame(list(truth.items()), "doc_id bigint, toxic int"))
    assert [r["doc_id"] for r in got.collect() if r["held_out"] and r["predicted"] != truth[r["doc_id"]]] == []


def test_toxicity_beyond_the_bounds_keeps_every_word_and_pair(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows, marks = [(None, None), (2000, ""), (3, "again w1 bad0"), (2001, "w1"), (2002, "bad1 bad1")], [(None, 1)]
    for i in range(240):
        body = [f"w{k}" for k in rng.integers(0, 40, rng.integers(1, 50))]
        if i % 4 == 0:
            body[len(body) // 2 :] = [f"bad{i // 4 % 9}", "w1", f"bad{i // 4 % 5}"]
        rows.append((i, " ".join(body)))
        marks.append((i, int(i % 4 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int")

    def scores():
        got = toxicity.score_toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted").collect()
        return sorted(map(tuple, got), key=lambda r: (r[0] is None, r)), sorted(map(str, toxicity.drop_toxic(docs, labels).collect()))

    whole, left = scores()
    assert {r[3] for r in whole} == {0, 1} and len(whole) == len(rows)
    for bounds in ({"MOST_WORDS": 3}, {"MOST_PAIRS": 1}, {"MOST_TOLD": 1}, {"MOST_TOXIC": 5, "MOST_ORDINARY": 5}):
        with monkeypatch.context() as m:
            for name, bound in bounds.items():
                m.setattr(toxicity, name, bound)
            got, also_left = scores()
        assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in whole], bounds
        assert np.allclose([r[2] for r in got], [r[2] for r in whole], rtol=0, atol=1e-9), bounds
        assert also_left == left, bounds


def test_toxicity_numbers_words_by_their_digests():
    import pyarrow as pa

    words = ["é", "plain", "b" * 300, "other"]
    table = pa.table({"word": words, "digest": pa.array([hashlib.md5(w.encode()).digest()[:8] for w in words], pa.binary())})
    numbers = toxicity.Numbers.of(table)
    assert [numbers.names[int(i)].as_py() for i in numbers.find(words)] == words
    assert numbers.find(["plain", "none", "other", "none"]).tolist() == [*numbers.find(["plain"]), -1, *numbers.find(["other"]), -1]
    assert toxicity.Numbers.of(table.slice(0, 0)).find(words).tolist() == [-1] * 4
    same = toxicity.Numbers(pa.array(["x", "y", "plain"]), np.full(3, numbers.digests[numbers.find(["plain"])[0]]))  # words that share a digest
    assert same.find(["plain", "other"]).tolist() == [2, -1]


def test_toxicity_scores_a_million_words_without_joins(spark, monkeypatch):
    """A vocabulary beyond 2^20 words shuffled each pair of neighbours of each text."""

    def joined(*_):
        raise AssertionError("texts met the model in joins")

    monkeypatch.setattr(toxicity.Tables, "of", joined)
    bodies = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(9_999)), lambda k: F.concat(F.lit("w"), (k + F.pmod("doc_id", F.lit(140)) * 10_000).cast("string"))))
    toxic = F.pmod(F.col("doc_id"), F.lit(4)) == 0
    docs = spark.range(420).withColumnRenamed("id", "doc_id").withColumn("text", F.concat(bodies, F.when(toxic, " vile").otherwise(" mild")))
    got = toxicity.score_toxicity(docs, docs.select("doc_id", toxic.cast("int").alias("toxic")))
    assert {(r["doc_id"] % 4 == 0, r["predicted"]) for r in got.select("doc_id", "predicted").collect()} == {(True, 1), (False, 0)}


def counts(text):
    w = [x for x in WHITE.split(text) if x]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WHITE.sub("", line):
            dup += line in seen
            seen.add(line)
    times, cover = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if times[tuple(w[k : k + 3])] > 1:
            cover |= {k, k + 1, k + 2}
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cover), failed


def test_quality_statistics(table):
    judged, name = quality.judge_quality(table)
    assert set(table.columns) <= set(judged.columns) and len(set(judged.columns)) == len(judged.columns)
    got = [(r["doc_id"], *[r[name[k]] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]) for r in judged.collect()]
    assert sorted(got, key=repr) == sorted([(i, *counts(x)) for i, x in texts(table)], key=repr)
    kept = judged.where(~judged[name["base_failed"]] | ~judged[name["kept"]])
    assert kept.count() == judged.count()


def brute_mcd(x):
    """The same estimate in numpy, for one group."""
    x = x.astype(float)
    at = np.floor(x / 16)
    centre = np.array([np.sort(at[:, k])[int(np.ceil(len(x) * 0.5)) - 1] * 16 + 8 for k in range(4)])
    floors = np.diag((np.array(quality.FLOORS) * quality.UNIT) ** 2)
    cov = floors
    for _ in range(quality.STEPS):
        d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
        bins = np.floor(16 * np.log2(1 + d))
        core = x[bins <= np.sort(bins)[int(np.ceil(len(x) * quality.CORE)) - 1]]
        centre, cov = core.mean(0), quality.consistency(quality.CORE) * np.cov(core.T, bias=True) + floors
    return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)


def test_quality_verdicts(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(260):
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(90)]
        if i % 10 == 0:
            words = [w + "%%%" for w in words]
        elif i % 10 == 1:
            words = [w.upper() + "!!#" for w in words]
        rows.append((i, " ".join(words), ("en", "fr")[i % 2], "abc"[i % 3]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged, name = quality.judge_quality(docs)
    got = {r["doc_id"]: r["kept"] for r in judged.collect()}
    assert got == {i: i % 10 > 1 for i in range(260)}
    slim = judged.select("doc_id", "lang", "source", *[f.alias(x) for f, x in zip(quality.features(name), quality.X)]).toPandas()
    for _, g in slim.groupby(["lang", "source"]):
        assert len(g) >= quality.GROUP_ROWS
        for i, d in zip(g["doc_id"], brute_mcd(g[quality.X].to_numpy())):
            assert got[i] == (d <= quality.CUT)
    assert quality.drop_poor(docs).columns == docs.columns


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a><li>More</ul></nav><div class="ad big">Buy</div><article><header><h1>Head &amp;
 line</h1></header><p><b>One<br>two<p>Three &lt;b&gt; &#233;</p><div class=share>Share</div></article>
<section id="comments"><article class="comment"><p>First!</p></article></section><aside>Side</aside><footer>F</footer>"""
PLAIN = "<body><div>Site name</div><div>{}</div><p>Own {}</p><form><p>Send</p></form><div>Imprint</div>"


def test_html(spark):
    rows = [(1, "http://h/a/1", PAGE), (2, "http://h/p/1", PLAIN.format("Menu", 2)), (3, "http://h/p/2", PLAIN.format("Menu", 3)), (4, None, None),
            (5, "http://g/p", PLAIN.format("Menu", 5)), (6, "http://g/p", PLAIN.format("Menu", 5)), (7, "nonsense", "<p>x")]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, n_chars int, lines string")
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(pages).collect()}
    assert got[1] == "Head & line\nOne two\nThree <b> é"
    assert (got[2], got[3], got[4], got[7]) == ("Own 2", "Own 3", "", "x")
    assert got[5] == got[6] == "Site name\nMenu\nOwn 5\nImprint"  # copies keep their lines
    assert html_text.main_texts(pages.limit(0)).collect() == []


def test_differencing_decides_outside_of_articles_too(spark):
    page = "<body><div>Site</div><div>Body of {0}</div><article class=teaser><p>Teaser</p></article><p>{0} ends</p><div>Imprint</div>"
    rows = [(i, f"http://h/{i}", page.format(i)) for i in (1, 2, 3)] + [(4, "http://h/4", "<p>Alone</p><div>Imprint</div>"), (5, "http://h/4", "<p>Alone</p><div>Imprint</div>")]
    got = {r[0]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in (1, 2, 3)] == [f"Body of {i}\nTeaser\n{i} ends" for i in (1, 2, 3)]
    assert got[4] == "Alone"  # the copy after it tells nothing, the page before it does
    lines = ["Menu", "Text", "Own", "Menu"]
    assert html_text.main_text(lines, "oaox", [["Menu", "Text"]]) == "Text\nOwn"
    assert html_text.main_text(lines, "oaox", [lines]) == html_text.main_text(lines, "oaox", []) == "Menu\nText\nOwn"


def test_labels_inside_an_article_need_more_evidence():
    page = ("<article><h2 id=discussion>Discussion</h2><section id=related-work><h2>Related work</h2><p>Read {0}</section><p id=social-history>History"
            "<div class=share-prices>Prices {0}</div><p>So <span class=ad-hoc>it</span> is<div class='box ad'>Buy</div><div id=share>Tell</div>"
            "<ul class=social-links><li><a href=/>Post {0}</a></ul><div class=promo-box>Join us</div><p><a class=share-link>Send {0}</a></article>")  # fmt: skip
    pages = [html_text.page_lines(page.format(i)) for i in "12"]
    want = "Discussion\nRelated work\nRead 1\nHistory\nPrices 1\nSo it is"
    assert html_text.main_text(*pages[0], [pages[1][0]]) == want
    assert html_text.main_text(*pages[0], []) == want + "\nJoin us"  # nobody agrees


def test_an_open_head_ends_where_the_body_begins():
    head = "<html><head><meta charset=utf-8><title>T</title><script>x()</script><noscript><p>No script</p></noscript>"
    for start in ("</head><body>", "<body>", "</head>", "", "<link rel=x>\n", "<noscript><body>"):
        for rest in ("<p>One<p>Two", "One<br><p>Two", "<img src=x>One<hr>Two"):
            assert html_text.page_lines(head + start + rest)[0] == ["One", "Two"], (start, rest)


def test_shared_lines_are_a_longest_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(0, 12)).astype(str).tolist() for _ in "ab")
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        found = [a[i] for i in sorted(html_text.shared_lines(a, b))]
        rest = iter(b)
        assert len(found) == best[-1, -1] and all(x in rest for x in found)


@pytest.mark.parametrize("few", [0, 16])
def test_parts_of_lines_that_repeat_are_aligned_as_well(few, monkeypatch):
    monkeypatch.setattr(html_text, "FEW", few)
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (rng.integers(0, rng.integers(1, 6), rng.integers(0, 25)).astype(str).tolist() for _ in "ab")
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        found = [a[i] for i in sorted(html_text.shared_lines(a, b))]
        rest = iter(b)
        assert len(found) == best[-1, -1] and all(x in rest for x in found)


def test_very_long_pages_take_seconds():
    start = time.process_time()
    assert len(html_text.shared_lines(["x"] * 100_000, ["x"] * 99_990)) == 99_990
    assert len(html_text.shared_lines(["a"] + ["x"] * 100_000, ["b"] + ["x"] * 60_000 + ["c"] + ["x"] * 20_000 + ["d"])) == 80_000
    for page in ("<div>" * 100_000 + "</p>" * 100_000 + "x", "<b>" * 50_000 + "<p></p>" * 50_000 + "x", "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000 + "x"):
        assert html_text.page_lines(page)[0] == ["x"]
    assert time.process_time() - start < 60


def test_texts_do_not_depend_on_the_ranges(spark):
    rows = [(i, f"http://{h}/{i % 7}/{i}", f"<div>Site {h}</div><div>Part {h} {i % 7}</div><p>Own {i}</p><div>Imprint {h}</div>") for i, h in enumerate(["a"] * 90 + ["b", "b", "c"] * 20)]
    rows += [(i, None, "<p>Nowhere</p><p>Own %d</p>" % i) for i in range(200, 210)] + [(1000 + k // 3, "http://z/", f"<p>Z</p><p>Own {k // 3}</p>") for k in range(30)] + [(None, "http://z/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    order = lambda r: (html_text_host(r[1]), r[1] or "", "" if r[0] is None else str(r[0]))
    ranked = sorted(rows, key=order)
    read = [html_text.page_lines(r[2] or "") for r in ranked]
    want = []
    for k, r in enumerate(ranked):
        beside = [read[j][0] for j in (k - 1, k + 1) if 0 <= j < len(rows) and order(ranked[j])[0] == order(r)[0]]
        want.append((r[0], r[1], html_text.main_text(*read[k], beside)))
    for ranges in (1, 2, 8, 211):
        got = [tuple(r)[:3] for r in html_text.main_texts(pages, ranges=ranges).collect()]
        assert Counter(got) == Counter(want), ranges
    assert {t for _, u, t in want if u and "/a/" in u} == {f"Own {i}" for i in range(90)}


def html_text_host(url):
    return "" if url is None else url.split("://")[1].split("/")[0]


def test_url_rules(spark):
    rules = spark.createDataFrame([*queries.URL_RULES, ("org", "/", "allow"), (None, "/", "block"), ("net", "/x", "block")], "host string, path string, verdict string")
    urls = [None, "", "nohost", "http://A.Example.ORG/es/1?x#y", "https://example.org/en/12", "http://example.org/en/2", "http://org", "http://org/",
            "x://notorg/", "http://a.com/fr/", "http://com/de/a", "http://xcom/de/", "http://n.net/xyz", "http://n.net/a?/x", "http://a.com?/fr/", "http://é.com/fr/é"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[3]])], "page_id long, url string, host string")
    want = []
    plain = [r for r in queries.URL_RULES] + [("net", "/x", "block")]
    for i, u in enumerate([*urls, urls[3]]):
        _, there, rest = (u or "").partition("://")
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups() if there else ("", "")
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fit = [(len(h + p), h + p, v) for h, p, v in plain if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((i, host, path, *(max(fit)[1:] if fit else (None, "allow"))))
    same(url_rules.judge_urls(pages, rules), want)
    assert url_rules.judge_urls(pages, rules.limit(0)).where("rule is not null or verdict <> 'allow'").count() == 0


def prints(text):
    w = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else [0]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(table):
    rows = [(i, prints(x)) for i, x in texts(table)]
    left, groups = set(f for _, f in rows), []
    while left:
        group, edge = set(), {left.pop()}
        while edge:
            group |= edge
            near = {f for f in left if any((f ^ g).bit_count() <= 3 for g in edge)}
            left -= near
            edge = near
        groups.append(group)
    first = {f: min((i for i, x in rows if x in g and i is not None), default=None) for g in groups for f in g}
    return [(i, f"{f:016x}", first[f]) for i, f in rows]


def test_simhash(spark, table):
    want = brute_groups(table)
    same(simhash.near_duplicates(table), want)
    kept = simhash.drop_near_duplicates(table)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({f for _, _, f in want})


def test_golay_keys_find_all_close_pairs(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**63), 2**63 - 1, 300)
    values = set(base.tolist())
    for x in base.tolist():
        for n in (1, 2, 3, 4):
            for b in rng.choice(64, n, replace=False).tolist():
                x ^= -(1 << 63) if b == 63 else 1 << b
            values.add(x)
    values = sorted(values)
    want = {(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = simhash.near_pairs(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    assert {tuple(r) for r in got} == want and len(want) > 300
    words = rng.integers(0, 1 << 23, 2000)
    code = golay.Golay()
    for b in range(23):
        assert (code.within_four(words ^ (1 << b)) == code.nearest(words)[:, None]).any(1).all()


def test_huffman_round_trip():
    rng = np.random.default_rng(1)
    for n, longest in ((1, 20), (2, 20), (9, 4), (700, 10), (3000, 20)):
        weights = (1e6 / (np.arange(n) + 1) ** 1.3).astype(np.int64) + 1
        lengths = token_files.code_lengths(weights, longest)
        assert lengths.max() <= longest and sum(2.0 ** -lengths.astype(float)) <= 1
        ids = rng.choice(n, 5000, p=weights / weights.sum())
        payload, marks = token_files.encode_ids(ids, token_files.canonical(lengths), lengths, 64)
        tokens = np.full(len(marks), 64)
        tokens[-1] = len(ids) - 64 * (len(marks) - 1)
        decoder = token_files.Decoder(lengths)
        assert (np.concatenate(decoder.decode(payload, marks, tokens)) == ids).all()
        assert (decoder.decode(payload, marks[3:4], tokens[3:4])[0] == ids[192:256]).all()  # any checkpoint alone


def test_token_files(spark, table):
    t = Tokenizer.from_file(queries.BYTE_BPE)
    path = token_files.write_token_files(table, queries.BYTE_BPE, fresh_path(spark, "files"))
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert sorted([(r[0], bytes(r[3])) for r in got], key=repr) == sorted(
        [(i, np.array(t.encode(x, add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, x in texts(table)], key=repr
    )
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x))


def test_exact_dedup(table):
    groups = defaultdict(list)
    for i, x in texts(table):
        groups[WHITE.sub(" ", x)].append(i)
    got = exact_dedup.exact_groups(table).collect()
    want = []
    for ids in groups.values():
        first = min((i for i in ids if i is not None), default=None)
        want += [(i, first, len(ids)) for i in ids]
    assert sorted([tuple(r)[:3] for r in got], key=repr) == sorted(want, key=repr)
    assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    kept = exact_dedup.drop_exact_copies(table)
    assert kept.columns == table.columns and kept.count() == len(groups)
    assert {hashlib.md5(WHITE.sub(" ", r["text"] or "").encode()).digest() for r in kept.collect()} == {hashlib.md5(k.encode()).digest() for k in groups}
