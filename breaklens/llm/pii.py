"""Personal data: generators propose overlapping spans, boosted trees choose among them.

Everything is DataFrame operations: Java regular expressions, array functions
and MLlib's gradient-boosted trees.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breaklens.session import written

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive quantifiers and look-behinds only spare the
# matcher what cannot match: a run of characters is tried once, from its
# start or from the end of the match before (\G), and never backed out of.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Candidates of high recall: obfuscated addresses, also with a port or prefix,
# long numbers in groups, numbers in telephone format without a plus.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}+"
             r"(?:\x20?(?:\.|(?:\[dot\]|\(dot\))\x20?)[A-Za-z0-9-]{2,63}+)++",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?:(?:\.|\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?)[0-9]{1,4}+){3}"
          r"(?::[0-9]{1,5}+|/[0-9]{1,2}+)?",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._/-]?[0-9]{4}){2}[\x20._/-]?[0-9]{1,7}+(?![0-9])",
    "phone": r"(?<![0-9+.])(?:00[0-9]{1,3}[\x20.-]?|\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20./-])[0-9]{2,5}"
             r"(?:[\x20.-]?[0-9]{2,5}){1,3}(?![0-9])",
}
CONTEXT = {
    "email": r"(?i)mail|contact|write|address",
    "ip": r"(?i)\bip\b|server|host|address|login|client",
    "card": r"(?i)card|visa|master|credit|debit|pay|account",
    "phone": r"(?i)phone|tel|call|fax|mobile|dial|whatsapp|contact",
}
# What stands for a sign in obfuscated candidates.
SIGNS = {"email": ((r"\x20?(?:@|\[at\]|\(at\))\x20?", "@"), (r"\x20?(?:\.|\[dot\]|\(dot\))\x20?", ".")),
         "ip": ((r"\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?", "."),)}
ADDRESS = r"^(?!.*\.\.)[A-Za-z0-9_+][A-Za-z0-9._%+-]*+(?<!\.)@(?:[A-Za-z0-9][A-Za-z0-9-]*+(?<!-)\.)++[A-Za-z]{2,24}$"
FEATURES = ("kind", "length", "digits", "groups", "separators", "letters", "distinct_digits", "longest_run",
            "luhn", "octets", "context", "number_before", "letter_before", "number_after", "letter_after",
            "address", "blank_sign")
# Features that tell nothing about a kind's format are 0 for it: a made-up wrong span differs in them, too.
FORM = {"email": ("address", "blank_sign"), "ip": ("octets",),
        "card": ("length", "digits", "groups", "separators", "distinct_digits", "longest_run", "luhn"),
        "phone": ("length", "digits", "groups", "separators", "distinct_digits", "longest_run")}
AROUND = ("context", "number_before", "letter_before", "number_after", "letter_after")
#: Share of right ones among the known candidates above a kind's threshold.
PRECISION = 0.99
#: Known negatives a threshold needs at least, else its kind gets no more spans.
LEAST_KNOWN = 50


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(
        d.try_cast("int") * 2 - F.when(d.try_cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def is_valid(kind: str, match: Column) -> Column:
    """What a base match must satisfy besides its pattern."""
    digits = only_digits(match)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$"))
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of all leftmost non-overlapping matches, in code points.

    The texts between the matches come from splitting by the same pattern;
    places are running sums of both lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("match"))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    placed = F.aggregate(
        pairs, F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["gap"]) + F.length(p["match"])).alias("at"),
            F.concat(a["out"], F.array(F.struct(
                (a["at"] + F.length(p["gap"])).alias("start"),
                (a["at"] + F.length(p["gap"]) + F.length(p["match"])).alias("end"),
                p["match"].alias("match")))).alias("out")),
        lambda a: a["out"])
    return F.when(text.rlike(pattern), placed).otherwise(none)


def _before(text: Column, m: Column) -> Column:
    return F.substring(text, F.greatest(m["start"] - 23, F.lit(1)), F.least(m["start"], F.lit(24)))


def _features(kind: str, text: Column, m: Column) -> Column:
    """The features of one proposed span, all as doubles; signs that stand for others count as these."""
    match = m["match"]
    for pattern, sign in SIGNS.get(kind, ()):
        match = F.regexp_replace(match, pattern, sign)
    digits, before = only_digits(match), _before(text, m)
    after = F.substring(text, m["end"] + 1, F.lit(1))
    runs = F.split(match, "[^0-9]+")
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    octets = F.regexp_extract(match, r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?!$)|(?=$|[:/]))){4}", 0) != ""
    values = {
        "kind": F.lit(float(KINDS.index(kind))), "length": F.length(match), "digits": F.length(digits),
        "groups": F.size(F.filter(runs, lambda r: r != "")), "separators": F.length(F.regexp_replace(match, r"[A-Za-z0-9+]", "")),
        "letters": F.length(F.regexp_replace(match, "[^A-Za-z]", "")),
        "distinct_digits": F.size(F.array_distinct(F.split(digits, ""))),
        "longest_run": F.array_max(F.transform(runs, F.length)), "luhn": flag(luhn(digits)), "octets": flag(octets),
        "context": flag(before.rlike(CONTEXT[kind])), "number_before": flag(before.rlike("[0-9]$")),
        "letter_before": flag(before.rlike("[A-Za-z]$")), "number_after": flag(after.rlike("[0-9]")),
        "letter_after": flag(after.rlike("[A-Za-z]")), "address": flag(match.rlike(ADDRESS)),
        "blank_sign": flag(m["match"].rlike(r"\x20[@.]|[@.]\x20")),
    }
    used = ("kind", *FORM[kind], *AROUND)
    return F.array(*(F.coalesce(values[f].cast("double"), F.lit(0.0)) if f in used else F.lit(0.0) for f in FEATURES))


def _twins(kind: str, text: Column, m: Column) -> list[tuple[Column, Column]]:
    """(match, known) of made-up spans in the place of a valid one: of wrong format, and without fitting context."""
    match = m["match"]
    if kind == "email":
        return [(F.reverse(match), F.reverse(match).rlike(ADDRESS).cast("int")),
                (F.regexp_replace(match, "@", " @ "), _before(text, m).rlike(CONTEXT[kind]).cast("int"))]
    if kind == "ip":
        return [(F.regexp_replace(match, "[0-9]+$", "999"), F.lit(0))]
    if kind == "card":
        last = ((F.substring(match, -1, 1).cast("int") + 1) % 10).cast("string")
        return [(F.concat(F.substring(match, F.lit(1), F.length(match) - 1), last), F.lit(0))]
    return [(F.regexp_extract(match, "^(?:[^0-9]*[0-9]){8}", 0), F.lit(0)), (F.concat(match, F.lit("-00000000")), F.lit(0))]


def _of_kind(k: int, with_known: bool) -> tuple[Column, Column]:
    """Arrays of the valid base spans and of the candidates of one kind."""
    kind, text = KINDS[k], F.col("_t")
    strict, wide, valid = (F.col(f"_{c}_{kind}") for c in "bwv")
    any_valid = F.concat(*(F.col(f"_v_{other}") for other in KINDS))
    shape = "array<struct<start:int,end:int,match:string,known:int>>"

    def with_label(m, match, known):
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), match.alias("match"), known.alias("known"))

    def competes(m):
        return (~F.exists(any_valid, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
                & ~F.exists(strict, lambda b: (b["start"] == m["start"]) & (b["end"] == m["end"])))

    proposed = F.transform(F.filter(wide, competes), lambda m: with_label(m, m["match"], F.lit(None).cast("int"))).cast(shape)
    if with_known:
        long_enough = strict if kind != "card" else F.filter(strict, lambda m: F.length(only_digits(m["match"])) >= 9)
        fits = lambda m: m["match"].rlike(ADDRESS) if kind == "email" else is_valid(kind, m["match"])
        known = F.transform(long_enough, lambda m: with_label(m, m["match"], fits(m).cast("int"))).cast(shape)
        made = F.flatten(F.transform(valid, lambda m: F.array(*(with_label(m, x, y) for x, y in _twins(kind, text, m)))))
        proposed = F.concat(known, made.cast(shape), proposed)
    candidates = F.transform(proposed, lambda m: F.struct(
        m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["known"].alias("known"),
        _features(kind, text, m).alias("x")))
    return F.transform(valid, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"))), candidates


def _valid(kind: str) -> Column:
    return F.filter(f"_b_{kind}", lambda m: is_valid(kind, m["match"]))


def _with_candidates(docs: DataFrame, cols: list[str], text_col: str, with_known: bool = True) -> DataFrame:
    """``cols`` (as c0, c1, ...), the text, base and candidates (the known ones too, if asked for) of every row."""
    out = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)),
                      F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    for kind in KINDS:
        out = (out.withColumn(f"_b_{kind}", matches(F.col("_t"), BASE[kind]))
               .withColumn(f"_w_{kind}", matches(F.col("_t"), WIDE[kind]))
               .withColumn(f"_v_{kind}", _valid(kind)))
    base, candidates = zip(*(_of_kind(k, with_known) for k in range(len(KINDS))), strict=True)
    return out.select(*(f"c{i}" for i in range(len(cols))), "_t", F.array_sort(F.concat(*base)).alias("base"),
                      F.concat(*candidates).alias("candidates"))


def propose(docs: DataFrame, cols: list[str], text_col: str = "text") -> DataFrame:
    """Written table of ``cols`` (as c0, c1, ...), base and candidates of every row's whole text (null: empty).

    base: (start, kind number, end) of the valid base matches, sorted.
    candidates: (start, kind, end, known, x): known is 1 for a base match of
    the right format, 0 for one that fails, either for a span made from a valid
    one (:func:`_twins`), null for a wide match that overlaps no valid base
    match of any kind and isn't a failing one itself; x are its features.
    """
    return written(_with_candidates(docs, cols, text_col).drop("_t"), "pii")


@dataclass
class SpanModel:
    """Each kind's boosted trees as (weight, tree), a tree as nested (feature, threshold, left, right)
    or a leaf's value, and one threshold per kind (none: the kind gets no further spans)."""

    trees: dict[int, list] = field(default_factory=dict)
    thresholds: dict[int, float] = field(default_factory=dict)

    def probability(self, x: Column) -> Column:
        """Of a candidate being right, by its features."""
        def value(node):
            if not isinstance(node, tuple):
                return F.lit(node)
            f, limit, left, right = node
            return F.when(x[f] <= limit, value(left)).otherwise(value(right))

        margin = F.lit(-50.0)
        for k, trees in self.trees.items():
            margin = F.when(x[0] == k, sum((value(tree) * weight for weight, tree in trees), F.lit(0.0))).otherwise(margin)
        return 1 / (1 + F.exp(-2 * margin))

    def spans(self, base: Column, candidates: Column) -> Column:
        """Base spans and the wide candidates that reach their kind's threshold, sorted."""
        if not self.thresholds:
            return base
        limit = F.create_map(*(F.lit(v) for pair in self.thresholds.items() for v in pair))
        more = F.filter(candidates, lambda c: c["known"].isNull() & c["kind"].isin(*self.thresholds)
                        & (self.probability(c["x"]) >= F.try_element_at(limit, c["kind"])))
        return F.array_sort(F.concat(base, F.transform(more, lambda c: F.struct(
            c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))))


def _vectors(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({f"f_{name}": F.col("x")[i] for i, name in enumerate(FEATURES)})
    return VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="features").transform(rows)


def _nested(node):
    """A fitted tree's nodes as plain tuples."""
    if node.subtreeDepth() == 0:
        return node.prediction()
    split = node.split()
    return split.featureIndex(), split.threshold(), _nested(node.leftChild()), _nested(node.rightChild())


def known_counts(found: DataFrame) -> DataFrame:
    """Written table of all known candidates of :func:`propose`, equal ones counted: kind, known, half, x, n.

    half (0 or 1) is told by a hash of the row and place. The table grows with
    the distinct features, not with the texts.
    """
    known = (found.select(F.explode(F.filter("candidates", lambda c: c["known"].isNotNull())).alias("c"), "c0")
             .select("c0", "c.*").withColumn("half", F.pmod(F.xxhash64("c0", "start", "kind"), F.lit(2)).cast("int")))
    counts = known.groupBy("kind", "known", "half", "x").agg(F.count("*").alias("n"))
    return written(counts.sortWithinPartitions("kind", "known", "half", "x"), "fit")


def fit_spans(found: DataFrame, precision: float = PRECISION, least_known: int = LEAST_KNOWN) -> SpanModel:
    """Each kind's trees, fitted to one half of all known candidates, thresholds set on the other half.

    Right and wrong candidates of a kind weigh the same in sum, in the fit and
    in the thresholds: a kind's threshold is the least score at which
    ``precision`` of the weight at or above it is right. A kind with fewer than
    ``least_known`` wrong candidates in the other half gets no threshold.
    """
    counts = known_counts(found)
    total = {(r.kind, r.half, r.known): r.n for r in
             counts.groupBy("kind", "half", "known").agg(F.sum("n").alias("n")).collect()}  # kinds x 4 rows
    model = SpanModel()
    for k in range(len(KINDS)):
        wrong, right = (total.get((k, 0, y), 0) for y in (0, 1))
        if not wrong or not right:
            continue
        share = F.when(F.col("known") == 1, (wrong + right) / (2 * right)).otherwise((wrong + right) / (2 * wrong))
        rows = counts.where((F.col("kind") == k) & (F.col("half") == 0)).withColumn("weight", F.col("n") * share)
        trees = GBTClassifier(labelCol="known", featuresCol="features", weightCol="weight", maxIter=10, maxDepth=4, seed=3).fit(
            _vectors(rows.select("known", "x", "weight")).select(F.col("known").cast("double"), "features", "weight"))
        model.trees[k] = [(w, _nested(t._java_obj.rootNode())) for w, t in zip(trees.treeWeights, trees.trees, strict=True)]
    if not model.trees:
        return model
    table = (counts.where("half = 1").select("kind", "known", "n", F.floor(model.probability(F.col("x")) * 100).alias("bin"))
             .groupBy("kind", "known", "bin").agg(F.sum("n").alias("n")).collect())  # kinds x 2 x 101 rows
    for k in model.trees:
        wrong, right = (total.get((k, 1, y), 0) for y in (0, 1))
        if not right or wrong < max(least_known, 1):
            continue
        for b in range(50, 100):
            bad, good = (sum(r.n for r in table if r.kind == k and r.known == y and r.bin >= b) for y in (0, 1))
            if good + bad and good / right >= precision * (good / right + bad / wrong):
                model.thresholds[k] = b / 100
                break
    return model


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, base and spans (start, kind number, end), sorted.

    base are the valid matches of the base patterns; spans are these and the
    wide candidates that the trees accept (each overlapping none of the base). Offsets are code points, ends exclusive. Null and empty texts
    have no spans; rows may repeat; other columns are not looked at.
    """
    found = propose(docs, [id_col], text_col)
    model = fit_spans(found)
    return found.select(F.col("c0").alias(id_col), "base", model.spans(F.col("base"), F.col("candidates")).alias("spans"))


def redact_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of :func:`find_pii` in ``text_col`` replaced by its kind in brackets (null stays null)."""
    model = fit_spans(propose(docs, [id_col], text_col))
    cols = docs.columns
    out = _with_candidates(docs, cols, text_col, with_known=False).withColumn("_s", model.spans(F.col("base"), F.col("candidates")))
    return out.select(*(F.when(F.col(f"c{i}").isNotNull(), redact(F.col(f"c{i}"), F.col("_s"))).alias(c)
                        if c == text_col else F.col(f"c{i}").alias(c) for i, c in enumerate(cols)))


def span_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("bigint")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every stretch covered by sorted ``spans`` replaced by its first kind's name in brackets."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, s):
        new = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1))
        inside = s["start"] < a["at"]
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(inside, a["out"]).otherwise(new).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(
        spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))))
