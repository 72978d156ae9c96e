"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a classifier is trained.

Strict patterns find the base spans. Looser patterns add candidates: numbers inside longer runs, numbers
without a country code, addresses spelled out. On every candidate, base spans included, five labelers vote
for, against or not at all: form, checksum, gazetteer, words before it, letters around it. Per kind, expectation-
maximisation over the counts of vote patterns (at most 3^5 of a kind) estimates how reliable each labeler is, and so
how likely each pattern is personal data. With these likelihoods as labels, a naive Bayes classifier of the
span (its shape and length, the words and letters beside it, its checksum) is counted over all candidates; it
decides on the candidates beyond the base. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelab.workspace import materialise

from .shared import col, side, text_of, with_row_tag

KINDS = ("email", "ip", "card", "phone")

#: The strict patterns, written so that no text makes them slow or deep: runs are taken whole, and tried from their start.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_AT, _DOT = r"(?:\x20?[\[({]\x20?(?:at|arroba|chez|@)\x20?[\])}]\x20?|\x20@\x20|\x20(?:at|arroba|chez)\x20)", r"(?:\x20?[\[({]\x20?(?:dot|punto|punkt|point|\.)\x20?[\])}]\x20?|\x20(?:dot|punto|punkt|point)\x20)"
#: Candidates beyond the base, of the same kinds.
LOOSE = (
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:{_AT}[A-Za-z0-9-]{{1,63}}+(?:(?:{_DOT}|\.)[A-Za-z0-9-]{{2,63}}+){{1,4}}|@[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{2,63}}+){{1,4}})",
    r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}(?:\.|\[\.\]|\(\.\)){1}){3}[0-9]{1,3}(?![0-9A-Za-z:.])|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])",
    r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])",
    r"(?<![0-9+(.-])(?:00[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9]|[.-][0-9])",
)
#: Letters of context kept on either side.
BEFORE, AFTER = 40, 24

# Word lists of the labelers.
TOP_DOMAINS = "com org net edu gov mil int info biz io eu us uk de fr es it nl at ch be pt pl se no dk fi ie ca au nz mx br ar cl co in jp cn ru".split()
CARD_STARTS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
PHONE_CODES = r"^(?:\+|00)(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
RESERVED = (0, 127, 255)
NEAR = (
    r"(?i)\b(?:e-?mail|mail|contact|contacto|kontakt|correo|courriel|adresse|write to|reach)\b",
    r"(?i)\b(?:ip|ipv[46]|host|server|servidor|serveur|address|from|client|login)\b",
    r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|kreditkarte|tarjeta|carte|payment|pay)\b",
    r"(?i)\b(?:phone|tel|telephone|mobile|cell|call|fax|telefon|handy|tel[eé]fono|m[oó]vil|t[eé]l[eé]phone|portable|whatsapp)\b",
)
AGAINST = r"(?i)\b(?:version|release|section|chapter|isbn|issn|doi|build|rfc|license|licence|invoice|order|ticket|page|figure|table)\b[^0-9]{0,12}$"

LABELERS = ("form", "check", "listed", "near", "edge")
STEPS = 30
#: Right votes and votes that each labeler starts with; the least share of either answer.
RIGHT, TRIALS, LEAST_SHARE = 7, 10, 0.02
#: Buckets of a feature's values in the classifier, and the weight of what is not known.
BUCKETS, SMOOTH = 4096, 1.0
#: Certainties are counted in thousandths, so that sums do not depend on their order.
UNIT = 1000


def _matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """All matches, and what lies before, between and after them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _with_gaps(matches: str, gaps: str) -> Column:
    """Each match with the number of letters skipped before it and the letters beside it."""
    before, after = lambda i: F.get(F.col(gaps), i), lambda i: F.get(F.col(gaps), i + 1)
    return F.transform(
        matches,
        lambda m, i: F.struct(m.alias("m"), F.length(before(i)).alias("skip"), F.right(before(i), F.lit(BEFORE)).alias("left"), F.left(after(i), F.lit(AFTER)).alias("right")),
    )


def _found(bodies: DataFrame) -> DataFrame:
    """``id`` and ``found``: per pattern (base, then loose) its matches with the letters skipped and the context."""
    text = F.col("body")
    number, sign, at = text.rlike("[0-9]"), F.contains(text, F.lit("+")), F.contains(text, F.lit("@"))
    spelled = at | text.rlike(r"(?:at|arroba|chez)[\])}\x20]")
    when = (at, number & F.contains(text, F.lit(".")), number, number & sign, spelled, number, number, number)
    none = F.array().cast("array<string>")
    out = bodies
    for i, (pattern, asked) in enumerate(zip(BASE + LOOSE, when)):
        out = out.withColumn(f"m{i}", F.when(asked, _matches(text, pattern)[0]).otherwise(none))
    for i, pattern in enumerate(BASE + LOOSE):
        out = out.withColumn(f"g{i}", F.when(F.size(f"m{i}") > 0, _matches(text, pattern)[1]))
    lists = [F.struct(F.lit(i).alias("pattern"), _with_gaps(f"m{i}", f"g{i}").alias("all")) for i in range(len(BASE + LOOSE))]
    found = F.filter(F.array(*lists), lambda x: F.size(x["all"]) > 0)
    return out.select("id", found.alias("found"))


def _luhn(digits: Column) -> Column:
    each = F.split(F.reverse(digits), "")
    twice = F.transform(each, lambda x, i: F.when(i % 2 == 1, (2 * x.cast("int")) % 10 + F.floor(x.cast("int") / 5).cast("int")).otherwise(x.cast("int")))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10 == 0


def _small(part: Column) -> Column:
    """Whether a part of an address is at most 255."""
    plain = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(F.length(plain) <= 3, plain.cast("int") <= 255).otherwise(False)


def _spans(found: DataFrame) -> DataFrame:
    """A row per match that counts as base or as candidate: ``tag``, ``kind`` (its number), ``base``, ``start``, ``end``, the text and context."""
    each = found.select("tag", F.explode("found").alias("f")).select("tag", "f.pattern", F.posexplode("f.all").alias("i", "x"))
    each = each.select("tag", "pattern", "i", "x.*").withColumn("n", F.length("m"))
    upto = Window.partitionBy("tag", "pattern").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.col("skip") + F.col("n")).over(upto)).withColumn("start", F.col("end") - F.col("n"))
    kind, base = F.col("pattern") % len(BASE), F.col("pattern") < len(BASE)
    digits = F.regexp_replace("m", "[^0-9]", "")
    n = F.length(digits)
    card = F.when((n >= 12) & (n <= 19), _luhn(digits)).otherwise(False)
    parts = F.split(F.regexp_replace("m", r"[\[\]()]", ""), r"\.")
    octets = F.when(F.size(parts) == 4, F.forall(parts, _small)).otherwise(F.contains(F.col("m"), F.lit(":")))
    checked = F.when(kind == 0, True).when(kind == 1, octets).when(kind == 2, card).otherwise((n >= 9) & (n <= 15))
    rows = placed.select("tag", kind.alias("kind"), base.alias("base"), "start", "end", "m", "left", "right", digits.alias("digits"), checked.alias("sound"))
    return rows.where(~F.col("base") | F.col("sound"))


def _clear(spans: DataFrame) -> DataFrame:
    """The base, and candidates that touch no base span of their text."""
    before = Window.partitionBy("tag").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("tag").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends, starts = F.max(F.when(F.col("base"), F.col("end"))).over(before), F.min(F.when(F.col("base"), F.col("start"))).over(after)
    marked = spans.withColumn("base_end", ends).withColumn("base_start", starts)
    free = (F.coalesce("base_end", F.lit(0)) <= F.col("start")) & (F.coalesce("base_start", F.col("end")) >= F.col("end"))
    return marked.where(F.col("base") | free).drop("base_end", "base_start")


def _votes(spans: DataFrame) -> DataFrame:
    """``spans`` with a vote (1, 0 or -1) of each labeler."""
    kind, digits = F.col("kind"), F.col("digits")
    yes = lambda c: F.when(c, 1).otherwise(-1)
    some = lambda c: F.when(c, 1).otherwise(0)
    domain = F.lower(F.regexp_extract("m", r"([A-Za-z]+)$", 1))
    first = F.regexp_extract("m", r"^0*([0-9]{1,3})\b", 1)
    same = digits.rlike(r"^([0-9])\1*$")
    near = F.lit(False)
    for i, pattern in enumerate(NEAR):
        near = F.when(kind == i, F.col("left").rlike(pattern)).otherwise(near)
    listed = (
        F.when(kind == 0, some(domain.isin(TOP_DOMAINS)))
        .when(kind == 1, yes(~first.isin([str(x) for x in RESERVED])))
        .when(kind == 2, yes(digits.rlike(CARD_STARTS)))
        .otherwise(some(F.regexp_replace("m", r"[^0-9+]", "").rlike(PHONE_CODES)))
    )
    check = F.when(kind == 0, yes(F.length(domain) >= 2)).when(kind == 3, F.when(same, -1).otherwise(yes((F.length(digits) >= 9) & (F.length(digits) <= 15)))).otherwise(yes(F.col("sound") & ~F.coalesce(same, F.lit(False))))
    glued = F.col("left").rlike(r"[\p{L}0-9_=/#@-]$") | F.col("right").rlike(r"^[\p{L}0-9_=/@-]")
    return spans.select(
        "*", some(F.col("base")).alias("form"), check.alias("check"), listed.alias("listed"),
        F.when(F.col("left").rlike(AGAINST), -1).when(near, 1).otherwise(0).alias("near"), F.when(glued, -1).otherwise(0).alias("edge"),
    )


def reliabilities(counts: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[float], dict[tuple[int, ...], float]]:
    """Share of personal data, each labeler's share of right votes, and the likelihood of each vote pattern.

    ``counts``: patterns of votes with their number of rows. Labelers are independent given the truth; one that does
    not vote says nothing. The first guess is the sum of votes. A labeler starts with ``RIGHT`` of ``TRIALS`` votes
    right, so that one with few votes is neither trusted nor thrown out.
    """
    likely = {p: min(0.95, max(0.05, 0.5 + 0.2 * sum(p))) for p, _ in counts}
    share, right = 0.5, [RIGHT / TRIALS] * len(LABELERS)
    for _ in range(STEPS):
        share = (sum(n * likely[p] for p, n in counts) + 1) / (sum(n for _, n in counts) + 2)
        share = min(1 - LEAST_SHARE, max(LEAST_SHARE, share))
        for i in range(len(LABELERS)):
            voted = [(n, likely[p] if p[i] > 0 else 1 - likely[p]) for p, n in counts if p[i]]
            right[i] = (sum(n * x for n, x in voted) + RIGHT) / (sum(n for n, _ in voted) + TRIALS)
        for p, _ in counts:
            odds = math.log(share / (1 - share)) + sum(v * math.log(r / (1 - r)) for v, r in zip(p, right))
            likely[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return share, right, likely


def _likelihoods(spark: SparkSession, votes: DataFrame) -> DataFrame:
    """A row per kind and vote pattern (at most 4 x 3^5): ``sure``, in thousandths."""
    rows = votes.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).collect()  # bounded by the patterns there are
    out = []
    for kind in range(len(KINDS)):
        counts = sorted((tuple(r[x] for x in LABELERS), r["n"]) for r in rows if r["kind"] == kind)
        out += [(kind, *p, round(UNIT * x)) for p, x in reliabilities(counts)[2].items()]
    schema = "kind int, " + ", ".join(f"{x} int" for x in LABELERS) + ", sure bigint"
    return spark.createDataFrame(out, schema)


def _shape(text: Column) -> Column:
    """Digits as 9, letters as a, runs as at most four."""
    plain = F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), r"\p{L}", "a")
    return F.regexp_replace(plain, r"(.)\1{3,}", "$1$1$1$1")


def _features() -> Column:
    """What the classifier sees of a span: the number of each feature and the bucket of its value."""
    word = lambda c, p: F.lower(F.regexp_extract(c, p, 1))
    letter = lambda c: _shape(F.regexp_replace(c, r"\s", " "))
    values = (
        _shape(F.col("m")),
        F.length("m").cast("string"),
        F.col("check").cast("string"),
        F.concat_ws(",", "listed", "near", "edge"),
        word(F.col("left"), r"(\S+)\s*$"),
        word(F.col("right"), r"^\s*(\S+)"),
        letter(F.concat(F.right("left", F.lit(1)), F.lit("|"), F.left("right", F.lit(1)))),
    )
    return F.array(*[F.struct(F.lit(i).alias("feature"), F.pmod(F.xxhash64(v), F.lit(BUCKETS)).cast("int").alias("bucket")) for i, v in enumerate(values)])


N_FEATURES = 7


def _accepted(labelled: DataFrame) -> DataFrame:
    """``tag``, ``kind``, ``start``, ``end`` of candidates beyond the base that the classifier takes. ``labelled`` has ``sure``; written."""
    used = labelled.select("tag", "kind", "base", "start", "end", "sure", _features().alias("features"))
    used = materialise(used, "span-features")
    each = used.select("kind", "sure", F.explode("features").alias("f")).groupBy("kind", "f.feature", "f.bucket")
    counts = each.agg(F.sum("sure").alias("yes"), F.sum(UNIT - F.col("sure")).alias("no"))
    whole = used.groupBy("kind").agg((F.sum("sure") / UNIT).alias("all_yes"), (F.sum(UNIT - F.col("sure")) / UNIT).alias("all_no"))
    # a value met seldom says nothing: its odds are drawn to those of all candidates
    share = (F.col("all_yes") + SMOOTH) / (F.col("all_yes") + F.col("all_no") + 2 * SMOOTH)
    prior = F.log(share / (1 - share))
    weigh = F.log((F.col("yes") / UNIT + SMOOTH * share) / (F.col("no") / UNIT + SMOOTH * (1 - share))) - prior
    model = materialise(counts.join(F.broadcast(whole), "kind").select("kind", "feature", "bucket", weigh.alias("weight")), "span-model")
    asked = used.where(~F.col("base")).select("tag", "kind", "start", "end", F.explode("features").alias("f")).select("tag", "kind", "start", "end", "f.*")
    summed = asked.join(side(model, 40), ["kind", "feature", "bucket"]).groupBy("tag", "kind", "start", "end").agg(F.sum(F.round("weight", 6)).alias("weight"))
    return summed.join(F.broadcast(whole.select("kind", prior.alias("prior"))), "kind").where(F.col("weight") + F.col("prior") > 0).select("tag", "kind", "start", "end")


def personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``spans`` of each row: an array of ``start``, ``end`` (code points, end exclusive), ``kind`` and ``base``, by start, then kind.

    Base spans are those of the strict patterns that hold (parts of an address up to 255, 12 to 19 digits that
    pass Luhn, 9 to 15 digits); they always stay. Added ones touch no base span, and of added ones that
    overlap the first stays. Null and empty texts have none; repeated rows give repeated rows; other columns
    are left out. An empty table gives one.
    """
    bodies = docs.select(col(id).alias("id"), text_of(text).alias("body"))
    found, tag = with_row_tag(_found(bodies), "matches")
    found = found.withColumnRenamed(tag, "tag")
    spans = materialise(_clear(_spans(found)), "spans")
    votes = _votes(spans)
    patterns = _likelihoods(docs.sparkSession, votes)
    labelled = votes.join(F.broadcast(patterns), ["kind", *LABELERS])
    added = _accepted(labelled).select("tag", "start", "end", "kind", F.lit(False).alias("base"))
    earlier = Window.partitionBy("tag").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    added = added.withColumn("taken", F.max("end").over(earlier)).where(F.coalesce("taken", F.lit(0)) <= F.col("start")).drop("taken")
    every = spans.where("base").select("tag", "start", "end", "kind", "base").unionByName(added)
    # the spans of one text, in order
    lists = every.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "base"))).alias("spans"))
    names = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform(F.coalesce("spans", F.array()), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(names, x["kind"]).alias("kind"), x["base"].alias("base")))
    return found.select("tag", "id").join(lists.hint("merge"), "tag", "left").select(F.col("id").alias(id), named.alias("spans"))


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def counted_spans(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Per row of ``personal_data``: the number of base spans of each kind, the hash of their list, and the list of all spans."""
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.size(F.filter(base, _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select(col(id), *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
