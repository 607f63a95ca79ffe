"""Personal data: broad candidates, boosted trees, calibrated thresholds.

Patterns with a check (a range, a checksum, a number of digits) give the base spans. Broader generators
propose further, overlapping candidates: numbers that fail the check, phone numbers without a plus
sign, mail addresses with the signs spelt out. A spelt-out address is written plainly first, and look
and check are those of the plain form. Boosted trees learn from format and context, never from
the check itself, how likely a candidate of that look passes its check. A kind's threshold is the
least score above which candidates pass in at least ``PRECISION`` of cases, by scores of trees that did
not see their documents and with ``PRIOR`` further cases at the kind's own rate; candidates above it are
added to the base spans. No number of candidates is asked for, so small tables go by the same rule.

No check can accept a number without its plus sign, so failing it says nothing: such numbers are open.
The trees tell them from numbers with a plus by look; the share of phone numbers among the open ones is
the largest that leaves no score with fewer open numbers than that share of phone numbers would bring,
and the threshold is the least score above which the open ones are phone numbers in ``PRECISION`` of cases
by that estimate. It takes phone numbers with and without a plus to look alike otherwise, however many
of each there are, and look-alikes to differ from them in some look.

Texts are searched in the row. Features are small integers, so the training set is the table of
their distinct combinations with counts, whose size is bounded by the number of combinations; the trees
are fitted to that table and scored as a column expression.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlake.llm.common import crc_bucket
from chatterlake.storage import fresh_path, write_table

KINDS = ["email", "ip", "card", "phone"]
PRECISION = 0.98
PRIOR = 1.0
FOLDS = 5
ROUNDS = 20
DEPTH = 3

# The patterns of the base spans. Possessive quantifiers and the look-behind change no
# match; they keep the search linear and free of recursion on very long runs.
_LOCAL = "[A-Za-z0-9._%+-]"
_START = rf"(?:(?<!{_LOCAL})|\G)"
EMAIL = rf"{_START}{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

# Generators beyond the base patterns.
_AT = r"\x20?[(\[]\x20?(?:at|AT)\x20?[)\]]\x20?"
_DOT = r"(?:\x20?[(\[]\x20?(?:dot|DOT)\x20?[)\]]\x20?|\.)"
SPELT_EMAIL = rf"{_START}{_LOCAL}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"
BARE_PHONE = r"\(?[0-9][\x20().0-9-]{5,}[0-9]"

#: (kind, pattern, what a text must hold to be searched)
_SEARCHES = [
    (0, EMAIL, "@"), (1, IP, None), (2, CARD, None), (3, PHONE, "+"),
    (0, SPELT_EMAIL, r"[(\[]\x20?(?:at|AT)\x20?[)\]]"), (3, BARE_PHONE, None),
]
#: Words that announce personal data, for the context feature.
CUES = r"(?i)(?:mail|contact|call|phone|tel|mobile|fax|card|visa|credit|account|ip|host|address)\W*$"


def _measured(search: int):
    """For a match and the text before it: what a span and its features need of the two."""
    return lambda m, gap: F.struct(
        F.lit(search).alias("search"), m.alias("m"), F.length(gap).alias("gap"),
        F.right(gap, F.lit(24)).alias("before"), F.left(gap, F.lit(2)).alias("head"))


def _searched(docs: DataFrame, text: str) -> DataFrame:
    """(row_no, doc_id, found): per search, its matches with the text between them measured."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.select("doc_id", whole.alias("t_")).withColumn("row_no", F.monotonically_increasing_id())
    none = F.array().cast("array<string>")
    for s, (_, pattern, sign) in enumerate(_SEARCHES):
        holds = F.col("t_").rlike(sign or "[0-9]") if sign is None or len(sign) > 1 else F.col("t_").contains(sign)
        out = out.withColumn(f"m{s}", F.when(holds, F.regexp_extract_all("t_", F.lit(pattern), F.lit(0))).otherwise(none))
    empty = F.array().cast(
        "array<struct<search:int,m:string,gap:int,before:string,head:string>>")
    parts = []
    for s, (_, pattern, _) in enumerate(_SEARCHES):
        zipped = F.zip_with(f"m{s}", F.split("t_", pattern, -1), _measured(s))
        parts.append(F.when(F.size(f"m{s}") > 0, zipped).otherwise(empty))
    return out.select("row_no", "doc_id", F.concat(*parts).alias("found"))


def _class(c: Column) -> Column:
    """0 nothing, 1 white space, 2 letter or digit, 3 other."""
    return (F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3))


#: A domain name or an address behind the at sign, for spelt-out mail addresses.
_HOST = rf"@(?:.*\.[A-Za-z][A-Za-z0-9-]*[A-Za-z0-9]|{_OCTET}(?:\.{_OCTET}){{3}})$"

FEATURES = ["kind", "digits", "groups", "length", "dots", "brackets", "left", "right", "cue", "lead"]


def candidates(found: DataFrame) -> DataFrame:
    """One row per match with its place (code points), its features and whether it passes its check."""
    order = Window.partitionBy("row_no", "search").orderBy("at")
    search = F.col("search")
    plain = F.regexp_replace(F.regexp_replace("m", _AT, "@"), _DOT, ".")
    m = F.when(search == 4, plain).otherwise(F.col("m"))
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    kinds = F.array(*[F.lit(k) for k, _, _ in _SEARCHES])
    placed = (
        found.select("row_no", "doc_id", F.posexplode("found").alias("at", "x")).select("row_no", "doc_id", "at", "x.*")
        .withColumn("end", F.sum(F.col("gap") + F.coalesce(F.length("m"), F.lit(0))).over(order))
        .withColumn("head", F.lead("head").over(order))
        .where(F.col("m").isNotNull())
    )
    passed = (
        F.when(search == 0, True)
        .when(search == 1, m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(search == 2, digits.between(14, 19) & F.call_function("luhn_check", F.regexp_replace("m", r"[\x20-]", "")))
        .when(search == 3, digits.between(10, 15))
        .when(search == 4, m.rlike(_HOST))
        .otherwise(digits.between(10, 15) & F.col("before").endswith("+"))
    )
    proposed = (
        F.when(search == 2, digits.between(13, 19)).when(search == 4, passed)
        .when(search == 5, digits.between(7, 15)).otherwise(search != 3))
    before = F.regexp_replace("before", r"\+$", "")
    return placed.select(
        "row_no", "doc_id", "search", F.element_at(kinds, search + 1).alias("kind"),
        (F.col("end") - F.length("m")).alias("start"), "end", passed.alias("passed"),
        ((search <= 3) & passed).alias("base"), proposed.alias("proposed"),
        ((search == 5) & ~F.col("before").endswith("+")).alias("open"),
        F.least(digits, F.lit(20)).alias("digits"),
        F.least(F.size(F.split(m, "[^0-9A-Za-z]+")), F.lit(7)).alias("groups"),
        F.least(F.floor(F.length(m) / 4), F.lit(9)).cast("int").alias("length"),
        F.least(F.length(m) - F.length(F.replace(m, F.lit("."))), F.lit(4)).alias("dots"),
        m.contains("(").cast("int").alias("brackets"),
        _class(F.right(before, F.lit(1))).alias("left"), _class(F.left("head", F.lit(1))).alias("right"),
        before.rlike(CUES).cast("int").alias("cue"),
        F.when(m.rlike("^[0-9]"), F.left(m, F.lit(1)).try_cast("int")).otherwise(F.lit(10)).alias("lead"),
    )


def fit_trees(x: np.ndarray, good: np.ndarray, bad: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH,
              rate: float = 0.4, ridge: float = 1.0) -> list:
    """Boosted regression trees of the logistic loss over counted feature rows.

    A tree is a leaf value, or (feature, bound, tree for values up to the bound, tree for the others).
    """
    margin = np.zeros(len(x))
    trees = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        for f in range(x.shape[1]) if level else ():
            values = x[rows, f]
            sums_g = np.bincount(values, g[rows], values.max() + 1).cumsum()[:-1]
            sums_h = np.bincount(values, h[rows], values.max() + 1).cumsum()[:-1]
            gain = (sums_g ** 2 / (sums_h + ridge) + (total_g - sums_g) ** 2 / (total_h - sums_h + ridge)
                    - total_g ** 2 / (total_h + ridge))
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
        _, f, bound = best
        if f is None:
            value = float(rate * total_g / (total_h + ridge))
            margin[rows] += value
            return value
        low = x[rows, f] <= bound
        return (f, bound, grow(rows[low], g, h, level - 1), grow(rows[~low], g, h, level - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        trees.append(grow(np.arange(len(x)), good * (1 - p) - bad * p, (good + bad) * p * (1 - p), depth))
    return trees


def _tree_value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, bound, low, high = tree
    return np.where(x[:, f] <= bound, _tree_value(low, x), _tree_value(high, x))


def _tree_column(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, bound, low, high = tree
    return F.when(F.col(FEATURES[f]) <= bound, _tree_column(low)).otherwise(_tree_column(high))


def probability(trees: list) -> Column:
    """Score of a candidate row from 0 to 1."""
    margin = reduce(lambda a, b: a + b, [_tree_column(t) for t in trees], F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def _scores(trees: list, x: np.ndarray) -> np.ndarray:
    margin = sum((_tree_value(t, x) for t in trees), np.zeros(len(x)))
    return 1 / (1 + np.exp(-margin))


def _alike(positives: np.ndarray, opened: np.ndarray) -> np.ndarray:
    """Expected positives among the open ones down to each score, of both counts summed by falling score.

    The share of positives among the open ones is bounded at every score by the open ones seen there
    over those that it would bring; both counts are taken two and one standard deviations wide.
    """
    most = (opened + 1 + 2 * np.sqrt(opened + 1)) / (opened[-1] + 1)
    least = np.maximum(positives - np.sqrt(positives), positives / 4) / positives[-1]
    share = min(1.0, (most[least > 0] / least[least > 0]).min())
    return np.minimum(opened, share * opened[-1] * positives / positives[-1])


def learn(found: DataFrame) -> tuple[list, dict[int, float]]:
    """Trees, and per kind the calibrated threshold; a kind without one adds nothing.

    The driver receives one row per distinct combination of features and fold, a number bounded by
    their ranges. Documents fall into ``FOLDS`` folds by crc32 of their ids; a fold is scored by trees of
    the others, and all of them calibrate. The trees returned are those of all documents.
    """
    fold = F.coalesce(crc_bucket(F.col("doc_id"), FOLDS), F.lit(0)).cast("int")
    table = (
        found.where("proposed").groupBy(*FEATURES, fold.alias("fold"))
        .agg(F.count_if("passed").alias("good"), F.count_if(~F.col("passed") & ~F.col("open")).alias("bad"),
             F.count_if("open").alias("open"))
        .orderBy(*FEATURES, "fold").collect()
    )
    if not table:
        return [], {}
    x = np.array([[r[f] for f in FEATURES] for r in table], np.int64).reshape(len(table), len(FEATURES))
    folds = np.array([r.fold for r in table], np.int64)
    good, bad, opened = (np.array([r[c] for r in table], float) for c in ("good", "bad", "open"))
    score = np.zeros(len(x))
    for k in set(folds):
        seen = folds != k
        trees = fit_trees(x[seen], good[seen], (bad + opened)[seen]) if seen.any() else []
        score[~seen] = _scores(trees, x[~seen])
    thresholds = {}
    for kind in range(len(KINDS)):
        rows = np.flatnonzero(x[:, 0] == kind)
        if not len(rows):
            continue
        rows = rows[np.argsort(-score[rows], kind="stable")]
        passed, seen, prior = good[rows].cumsum(), (good[rows] + bad[rows]).cumsum(), PRIOR
        if opened[rows].any():  # what is added are open ones, so they alone are judged
            if len(set(folds[rows][good[rows] > 0])) < 2:
                continue  # no trees have seen a number with a plus that they did not learn
            seen, prior = (bad[rows] + opened[rows]).cumsum(), 0.0  # _alike has its own
            passed = _alike(passed, opened[rows].cumsum())
        last = np.append(score[rows][1:] < score[rows][:-1], True)  # ties stay together
        rate = passed[-1] / seen[-1]
        fit = np.flatnonzero(last & (passed + prior * rate >= PRECISION * (seen + prior)))
        if len(fit):
            thresholds[kind] = float(score[rows][fit[-1]])
    return fit_trees(x, good, bad + opened), thresholds


def spans(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): row_no and doc_id of every row; row_no, kind, start, end, base, score of every span.

    Starts and ends count code points, the end is exclusive. Base spans always stay. A candidate is
    added if its score reaches its kind's threshold and it overlaps no base span; added spans may
    overlap each other. Null counts as empty and has no spans; repeated rows each have their own.
    """
    spark = docs.sparkSession
    searched = write_table(_searched(docs, text), fresh_path(spark, "pii-matches"))
    found = write_table(candidates(searched), fresh_path(spark, "pii-candidates"))
    trees, thresholds = learn(found)
    least = reduce(lambda c, k: c.when(F.col("kind") == k, thresholds[k]), thresholds, F.when(F.lit(False), 0.0))
    scored = found.withColumn("score", probability(trees))
    chosen = scored.where(F.col("base") | (F.col("proposed") & (F.col("score") >= least)))
    order = Window.partitionBy("row_no").orderBy("start")
    earlier = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = order.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    covered = (
        (F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(earlier), F.lit(0)) > F.col("start"))
        | (F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(later), F.col("end")) < F.col("end"))
    )
    kept = chosen.withColumn("covered", covered).where(F.col("base") | ~F.col("covered"))
    return searched.select("row_no", "doc_id"), kept.select("row_no", "kind", "start", "end", "base", "score")


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and digest are those of the base spans; ``spans`` lists all as kind:start:end by start,
    then kind. Other columns are ignored; an empty table gives no rows.
    """
    rows, found = spans(docs, text)
    listed = F.transform(F.sort_array("all"), lambda s: F.concat_ws(
        ":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s.kind + 1), s.start.cast("string"), s.end.cast("string")))
    base = F.filter(F.col("all"), lambda s: s.base)
    per_row = found.groupBy("row_no").agg(
        F.collect_set(F.struct("start", "kind", "end", "base")).alias("all"),
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{name}") for k, name in enumerate(KINDS)])
    texts = per_row.withColumn("spans", F.array_join(listed, ",")).withColumn("all", base).withColumn(
        "base_text", F.array_join(listed, ","))
    return rows.join(texts, "row_no", "left").select(
        "doc_id", *[F.coalesce(f"n_{name}", F.lit(0).cast("bigint")).alias(f"n_{name}") for name in KINDS],
        F.sha2(F.coalesce("base_text", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in brackets; overlapping spans merge.

    The text is cut at the spans in the row, so it moves once, to its row number.
    """
    numbered = write_table(docs.select("doc_id", F.col(text).alias("text")), fresh_path(docs.sparkSession, "pii-texts"))
    rows, found = spans(numbered, "text")
    order = Window.partitionBy("row_no").orderBy("start", F.col("end").desc(), "kind")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        found.withColumn("new", (before.isNull() | (F.col("start") >= before)).cast("int"))
        .withColumn("piece", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row_no", "piece").agg(F.min("start").alias("start"), F.max("end").alias("end"),
                                        F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    )
    cuts = merged.groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    texts = numbered.withColumn("row_no", F.monotonically_increasing_id())
    pieces = F.expr("transform(cuts, (c, i) -> concat(substring(text, IF(i = 0, 0, cuts[i - 1].end) + 1, "
                    "c.start - IF(i = 0, 0, cuts[i - 1].end)), names_[c.kind]))")
    tail = F.expr("substring(text, cuts[size(cuts) - 1].end + 1)")
    return texts.join(cuts, "row_no", "left").withColumn("names_", names).select(
        "doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(
            F.concat(F.array_join(pieces, ""), tail)).alias("text"))
