"""Ranked search, the conversation trie and personal data against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelab.llm import conversation_trie, lexical_search, pii, queries, running
from cuelab.llm.perfect_hash import PerfectHash, digests

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id bigint, text string, item_id string, score int, rank string, n int, spans string, tag int, kind string"


def rows_of(pairs):
    return [(i, t, "x", 1, "r", 2, "s", 3, "k") for i, t in pairs]


# --- ranked search


def best(docs, items, k=20):
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n_docs, all_terms = sum(bool(t) for t in terms), sum(map(len, terms))
    counts = [Counter(t) for t in terms]
    df = Counter(x for c in counts for x in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for (doc, _), c, t in zip(docs, counts, terms):
            score = 0
            for x, times in asked.items():
                if c[x]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                    score += times * w * (1_000_000_000 * c[x] // (1000 * c[x] + 12 * (75 + 25 * len(t) * n_docs // all_terms)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return out


TEXTS = [
    (4, "a b b c"), (2, "a b b c"), (9, "A b, B... c"), (7, None), (8, ""), (None, "a b b c"), (None, "a"), (4, "a b b c"), (3, "é É straße 12 a_b"),
    (5, "x " * 40000 + "rare"), (6, "y" * 300000), (10, " \t.\n"), (11, "c c c c c c\x00a\x7fb"), (12, "日本 語 a"),
]
ITEMS = [(1, "a b c"), (2, "b b rare É"), (1, "c"), (None, "a"), (3, None), (4, "--"), (5, "nowhere"), (6, "A a a 日本"), (6, "A a a 日本"), (7, "x")]


@pytest.mark.parametrize("partitions, k", [(1, 20), (5, 2)])
def test_search_equals_scoring_every_document(spark, partitions, k):
    docs = spark.createDataFrame(rows_of(TEXTS), DOC).repartition(partitions)
    items = spark.createDataFrame([(*x, 9, "s") for x in ITEMS], "item_id int, text string, doc_id int, score string")
    got = lexical_search.search(docs, items, k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(best(TEXTS, ITEMS, k), key=repr)


def test_search_reads_in_rounds_and_blocks_of_documents_and_items(spark, monkeypatch):
    """Small blocks and rounds; thousands of documents with many equal scores."""
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 12)
    rng = np.random.default_rng(1)
    texts = [(int(i), " ".join(f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(1, 30)) if x < 40)) for i in rng.permutation(3000)]
    items = [(i, " ".join(f"w{int(x)}" for x in rng.integers(1, 40, 6))) for i in range(6)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(2)
    got = lexical_search.search(docs, spark.createDataFrame(items, "item_id int, text string"), k=7)
    assert sorted(map(tuple, got.collect())) == sorted(best(texts, items, 7))


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_search_of_a_block_stops_with_all_of_the_best(data):
    terms, docs = data.draw(st.integers(1, 6)), data.draw(st.integers(1, 60))
    cells = data.draw(st.lists(st.tuples(st.integers(0, docs - 1), st.integers(0, terms - 1)), unique=True, min_size=1, max_size=200))
    of, term = np.array(sorted(cells)).T
    tf = np.array(data.draw(st.lists(st.integers(1, 3), min_size=len(cells), max_size=len(cells))))
    weight = np.array(data.draw(st.lists(st.integers(0, 5), min_size=terms, max_size=terms)))
    n = np.bincount(of, weights=tf, minlength=docs).astype(int)
    block = lexical_search._Block(n, of, term, tf, weight, docs, int(n.sum()))
    asked = np.array(data.draw(st.lists(st.integers(0, terms - 1), unique=True, min_size=1)))
    k = data.draw(st.integers(1, 5))
    score, doc = block.search(asked, np.ones(len(asked), int), k, np.empty(0, int))
    want = Counter()
    for d, t, f in zip(of, term, tf):
        want[d] += int(weight[t]) * (1_000_000_000 * int(f) // (1000 * int(f) + 12 * (75 + 25 * int(n[d]) * docs // int(n.sum())))) * (t in asked)
    first = sorted(((-s, d) for d, s in want.items() if s > 0))[:k]
    assert sorted((-s, d) for s, d in zip(score, doc) if s > 0)[:k] == first


def test_search_stops_early():
    """Of a long list only the start is read when the bound falls below the k-th score."""
    docs = 5000
    n = np.arange(1, docs + 1) * 10
    block = lexical_search._Block(n, np.arange(docs), np.zeros(docs, int), np.ones(docs, int), np.array([1000]), docs, int(n.sum()))
    score, doc = block.search(np.array([0]), np.array([1]), 5, np.empty(0, int))
    assert len(doc) < 250 and set(range(5)) <= set(doc.tolist())
    assert not len(block.search(np.array([0]), np.array([1]), 1, np.array([10**9]))[1])  # earlier blocks have better ones


@pytest.mark.parametrize("docs, items", [([], ITEMS), (TEXTS, []), ([(1, None), (2, "")], ITEMS), ([], [])])
def test_search_of_nothing(spark, docs, items):
    found = lexical_search.search(spark.createDataFrame(rows_of(docs), DOC), spark.createDataFrame(items, "item_id int, text string"))
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and not found.count()


def test_terms_of_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 7)
    for text in ("", "a", "   ", "abcdefghijklmnop qrs", "a b c d e f g h i j", " abcdefghij  k", "é" * 20 + " Z"):
        got = [w.decode() for words in lexical_search.terms(text.encode()) for w in words]
        assert got == TERM.findall(text.translate(LOWER))


# --- conversation trie


def rebuilt(rows, every=5, most=8):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % (most + 1) for c in own}
    return {c: own.get(c - c % every, [])[: h[c]] + t[h[c] :] for c, t in own.items()}


def nodes(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items()]


def talk(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, 7, "p", b"d") for r in rows], "conv_id bigint, turn int, role string, text string, depth int, place string, digest binary").repartition(partitions)


def some_talk():
    rng = np.random.default_rng(3)
    rows = []
    for c in [*range(40), 1000, 1004]:
        for t in range(int(rng.integers(1, 14))):
            rows.append((c, int(t), ["u", "a", None][int(rng.integers(3))], ["hi", "é", "", None, "long " * 9][int(rng.integers(5))]))
    rows += [(50, None, "u", "first"), (50, 1, "u", "b"), (50, 1, "u", "a"), (50, 1, "u", "a"), (None, 1, "u", "lost"), (53, 0, "u", "x" * 200000), (54, 0, "u", "x" * 200000)]
    for c in range(60, 90):  # copies of one long conversation, and one that goes on
        rows += [(c, t, "u", f"copy {t}") for t in range(12 if c < 89 else 15)]
    return rows


def query(turns):
    return conversation_trie.trie(*conversation_trie.with_lent_heads(conversation_trie.numbered(conversation_trie.turn_keys(turns)), every=5, most=8))


def test_trie_of_rebuilt_conversations(spark):
    rows = some_talk()
    got = query(talk(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(nodes(rebuilt(rows)), key=repr)


@pytest.mark.parametrize("heavy, shard, block", [(1, 1 << 16, 1 << 17), (3, 4, 2), (1 << 14, 2, 1)])
def test_trie_in_small_pieces(spark, monkeypatch, heavy, shard, block):
    """A deep trunk, many shards, blocks of one level: the nodes are the same."""
    for name, value in (("HEAVY", heavy), ("SHARD_NODES", shard), ("BLOCK_NODES", block), ("CHUNK", 3)):
        monkeypatch.setattr(conversation_trie, name, value)
    rows = [(c, t, "u", str((c % 4) ** 2 // (t + 1)) + "é" * t) for c in range(30) for t in range(c % 7 + 1)]
    plain = {c: [("u", x[3]) for x in rows if x[0] == c] for c in range(30)}
    got = conversation_trie.prefix_trie(talk(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(nodes(plain), key=repr)


def test_trie_without_turns_or_conversations(spark):
    assert query(talk(spark, [])).count() == 0 and conversation_trie.prefix_trie(talk(spark, [])).count() == 0
    rows = [(c, 0, "u", "only") for c in range(1, 200) if zlib.crc32(str(c).encode()) % 9 and c % 5]
    got = query(talk(spark, rows)).collect()  # nobody lends, the own turn is cut off
    assert [tuple(r) for r in got] == nodes(rebuilt(rows)) and got[0].n_leaves == 1


def test_a_long_conversation_is_cut_into_ranges(spark):
    rows = [(1, t, "u", "x") for t in range(3000)] + [(2, t, "u", "x") for t in range(2999)]
    got = {(r.conv_id, r.depth): r for r in conversation_trie.prefix_trie(talk(spark, rows)).collect()}
    assert len(got) == 3001 and got[1, 0].saved_tokens == 2999 and got[1, 3000].n_convs == 1 and got[1, 1500].n_convs == 2


def test_running_does_not_depend_on_ranges(spark):
    df = spark.createDataFrame([(i % 3, i, 2 * i) for i in range(100)], "k int, o int, x bigint")
    got = running.running(df.repartition(7), "k", [F.col("o")], ("x",)).collect()
    for r in got:
        same = [i for i in range(100) if i % 3 == r.k]
        assert (r.place, r.size, r.upto_x, r.all_x) == (same.index(r.o) + 1, len(same), 2 * sum(i for i in same if i <= r.o), 2 * sum(same))


@settings(max_examples=100, deadline=None)
@given(st.sets(st.binary(min_size=16, max_size=16), max_size=300), st.sets(st.binary(min_size=16, max_size=16), max_size=50))
def test_perfect_hash(keys, others):
    table = PerfectHash(digests(sorted(keys)))
    assert sorted(table.slots) == list(range(len(keys)))
    assert (table.find(digests(sorted(keys))) == table.slots).all()
    strange = sorted(others - keys)
    assert (table.find(digests(strange)) == -1).all()


def test_perfect_hash_refuses_repeated_digests():
    with pytest.raises(ValueError):
        PerfectHash(digests([b"a" * 16, b"a" * 16]))


# --- personal data

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(x):
    return sum(int(c) if not i % 2 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(x))) % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    good = [
        lambda m: True, lambda m: all(int(x) <= 255 for x in m.split(".")), lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15,
    ]
    found = [(m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if good[k](m.group())]
    return [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


CARD = "4845168114407329"
ODD = [
    "mail a.b+c@x-y.co.uk, c@d, @e.f, g@h..i x@y.z@w.v.u %@-.-", "a@b.c_d@e.f@g.h", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 0001.0255.03.4 1..2.3.4.5 256.1.1.1",
    f"card {CARD} {CARD[:4]}-{CARD[4:8]} {CARD[8:12]} {CARD[12:]} 1234567890123456 {CARD}{CARD}", f"7{CARD} 12 {CARD}x", "0" * 19 + " " + "0" * 20,
    "+1 (017) 555-7713 +12345678 +49.30-12345678901234 ++49 30 1234567 +1-", "😀é +33 1 23 45 67 89 ünï@exämple.com x@exa.mple😀", "10.0.0.1\n+44 20 7946 0958\t" + CARD, "", " ", "no data",
]
HEAVY = ["1" * 200000, "a" * 200000, "a@" + "b." * 50000 + "c", "1.2.3.4 " * 20000, "1 " * 100000, "+" * 100000, "+1" + "(" * 100000, "x@y.z " * 10000]


def test_base_spans_equal_the_patterns(spark):
    texts = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (3, ODD[3]), (None, ODD[0]), (77, None)]
    got = pii.counted_spans(pii.personal_data(spark.createDataFrame(rows_of(texts), DOC))).collect()
    assert len(got) == len(texts)
    want = sorted((str(i), hashlib.sha256(",".join(base(t or "")).encode()).hexdigest(), *[sum(x.startswith(k) for x in base(t or "")) for k in pii.KINDS]) for i, t in texts)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    for r in got:
        spans = r.spans.split(",") if r.spans else []
        assert set(base(dict(texts)[r.doc_id] or "")) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])))


def test_long_runs_and_many_spans(spark):
    rows = pii.counted_spans(pii.personal_data(spark.createDataFrame(rows_of(enumerate(HEAVY)), DOC))).collect()
    for r in rows:
        if r.doc_id == 0:  # the plain pattern is quadratic here; a run of equal digits has no address
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (0, 0, 0, 0)
        elif r.doc_id != 1:
            assert r.base_sha256 == hashlib.sha256(",".join(base(HEAVY[r.doc_id])).encode()).hexdigest()


def test_added_spans(spark):
    """A card beside another number, an address spelled out, numbers without a country code; no number whose sum fails."""
    rng = np.random.default_rng(5)
    plain = [f"word {rng.integers(10**9, 10**10)} her card {CARD} mail p{i}@mail{i % 7}.example.com phone +1 (555) 555-{i:04d} host 10.1.{i % 200}.7 and" for i in range(300)]
    asked = [
        f"pay by card 7536784127813051 {CARD} now", "mail john.doe [at] example [dot] com please", "call (017) 555-7713 tel 017-555-7713", "version 12 3456 7890 of 7536784127813051",
    ]
    table = spark.createDataFrame(rows_of(enumerate(asked + plain)), DOC)
    got = {r.doc_id: [(asked[r.doc_id][s.start : s.end], s.kind, s.base) for s in r.spans] for r in pii.personal_data(table).where("doc_id < 4").collect()}
    assert got[0] == [(CARD, "card", False)]
    assert got[1] == [("john.doe [at] example [dot] com", "email", False)]
    assert ("(017) 555-7713", "phone", False) in got[2]
    assert not [x for x in got[3] if x[1] == "card"]


def test_reliabilities_find_the_labelers_that_err():
    """Votes drawn from known reliabilities: the estimates come close, an adversarial labeler is seen through."""
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.4
    right = (0.95, 0.9, 0.85, 0.7, 0.5)
    votes = np.stack([np.where(rng.random(len(truth)) < p, truth, ~truth) * 2 - 1 for p in right], 1)
    counts = Counter(map(tuple, votes.tolist()))
    share, found, likely = pii.reliabilities(sorted(counts.items()))
    assert abs(share - 0.4) < 0.02
    assert all(abs(a - p) < 0.03 for a, p in zip(found, right))
    assert np.mean([(likely[tuple(v)] > 0.5) == y for v, y in zip(votes.tolist(), truth)]) > 0.95
    assert pii.reliabilities([])[2] == {}


def test_nothing_to_find(spark):
    empty = pii.counted_spans(pii.personal_data(spark.createDataFrame([], DOC)))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    one = pii.counted_spans(pii.personal_data(spark.createDataFrame(rows_of([(1, "nothing here")]), DOC))).collect()
    assert [tuple(r) for r in one] == [(1, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")]


def test_personal_data_runs_in_the_jvm(spark):
    plan = queries.op13_personal_data(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_queries_on_whole_tables(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_personal_data(spark, SF).collect()
    assert {(r.doc_id, r.base_sha256) for r in rows} == {(i, hashlib.sha256(",".join(base(t)).encode()).hexdigest()) for i, t in docs.items()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, queries.op11_ranked_search(spark, SF).collect())) == sorted(best(list(docs.items()), items))
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op12_conversation_trie(spark, SF).collect()), key=repr) == sorted(nodes(rebuilt(turns)), key=repr)
