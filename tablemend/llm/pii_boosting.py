"""Personal data: candidate spans scored by boosted trees.

Base spans follow four closed rules and always stay. Wide generators propose further, overlapping candidates.
Boosted trees score these by their format and context; per kind, the lowest threshold that keeps the wanted
precision on held-out rows selects the ones that are added.

There are no labels for spans, so the trees learn from the corpus itself: all different base spans give positives,
together with the same spans rewritten in looser forms ("name at host dot com", a phone number without its plus).
Candidates that meet no base span may be the loose forms that are sought, so only those with evidence of their own
(wrong check digits or octets, dates, parts of ids, tables of numbers, no domain) give negatives, as do base spans with
broken digits or of another kind; the others have no label. Examples of equal features become one row, weighted by
their number: trees and thresholds are fitted on all of them (Spark alone picks the values it tries as splits). The
trees become one column expression, so that finding spans is a map over the rows: no shuffle, and nothing is gathered
per document, source or key.

Rows: NULL text is empty and has no spans. Rows are independent, so repeated ids and rows each give a row. Tables
without any base span get no trees and no added spans. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import let, saved

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 16

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"

# fixed values: the closed rules, with possessive quantifiers where giving back cannot help
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

_AT, _DOT = r"\x20?(?:@|[\[(]at[\])]|\x20at\x20)\x20?", r"(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)"
#: what follows the name in a wide e-mail whose sign is a word
_AT_HOST = rf"\x20at\x20\x20?{_HOST}++{_DOT}{_HOST}"
WIDE = {
    "email": rf"(?<!{_LOCAL})[A-Za-z0-9._%+-]{{1,64}}+{_AT}{_HOST}++(?:{_DOT}{_HOST}++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]++(?:\.[0-9]++){3,5}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])",
    "card": r"[0-9]++(?:[\x20./-]{1,2}[0-9]++)*+",
    "phone": r"(?<![0-9A-Za-z])[+(]?[0-9]++(?:[\x20()./-]{1,3}[0-9]++)*+",
}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes Luhn's check."""
    doubled = F.transform(
        F.split(F.reverse(number), ""),
        lambda c, at: F.when(at % 2 == 0, c.cast("int")).otherwise(
            c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    count = F.length(digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return count.between(14, 19) & let(digits(value), luhn)
    if kind == "phone":
        return count.between(10, 15)
    return F.lit(True)


#: what every number-like span holds: seven characters or more of digits and what joins them
_NUMERIC = r"[0-9][\x20()./:0-9-]{6}"


def _hint(kind: str, text: Column, numeric: Column, wide: bool = False) -> Column:
    """A cheap test that texts without a match mostly fail and texts with one always pass."""
    if kind == "email" and wide:
        marked = text.contains("@") | text.contains("at]") | text.contains("at)")
        return marked | (text.contains(" at ") & text.rlike(_AT_HOST))
    if kind == "email":
        return text.contains("@")
    if kind == "ip" and wide:
        return numeric | text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:")
    return numeric & text.contains("+") if kind == "phone" and not wide else numeric


def base(text: Column, kind: str, numeric: Column) -> Column:
    """Spans of one closed rule, with context."""
    return spans.matches(text, BASE[kind], lambda v: _valid(kind, v), when=_hint(kind, text, numeric), context=CONTEXT)


def candidates(text: Column, kind: str, known: Column, numeric: Column) -> Column:
    """Proposals of one wide generator that meet no known span."""
    found = spans.matches(text, WIDE[kind], when=_hint(kind, text, numeric, wide=True), context=CONTEXT)
    wanted = {"email": lambda v: v.rlike("[A-Za-z]"), "ip": lambda v: F.length(v) >= 7}.get(
        kind, lambda v: F.length(digits(v)).between(10, 19)
    )
    return F.filter(
        found,
        lambda s: wanted(s["value"])
        & ~F.exists(known, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])),
    )


_DATE = r"^[(+]?(?:[0-9]{4}[-./\x20][0-9]{1,2}[-./\x20][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4})(?![0-9])"


def disproved(kind: str, span: Column) -> Column:
    """Whether a candidate is no personal data by other evidence than that no base span meets it."""
    value, left, right = span["value"], span["left"], span["right"]
    count = F.length(digits(value))
    if kind == "email":  # a number or the next sentence in place of a domain
        return value.rlike(r"(?:\.|dot[\])]?\x20?)(?:[A-Za-z]|[A-Za-z-]*[0-9][A-Za-z0-9-]*)$") | value.rlike(r"[a-z]\.[A-Z][a-z]*$")
    if kind == "ip":
        return ~value.contains(":") & ~_valid("ip", value)
    part_of_id = left.rlike("[0-9A-Za-z_][.:/_-]?$") | right.rlike("^[.:/_-]?[0-9A-Za-z_]")
    table = left.rlike(r"(?:[0-9]+[\s,;|.]+){3}$") & right.rlike(r"^(?:[\s,;|.]+[0-9]+){2}")
    wrong = (count < 14) | ~let(digits(value), luhn) if kind == "card" else count > 15
    return wrong | value.rlike(_DATE) | part_of_id | table


def features(kind: Column, value: Column, left: Column, right: Column) -> list[Column]:
    """Format and context of a candidate as numbers."""
    count = lambda of, pattern: F.length(F.regexp_replace(of, pattern, ""))
    flag = lambda test: F.when(test, 1).otherwise(0)
    number = digits(value)
    groups = F.transform(
        F.filter(F.split(value, "[^0-9]+"), lambda g: g != ""), lambda g: F.length(g)
    )
    columns = [
        kind,
        F.length(value),
        F.length(number),
        count(value, "[^A-Za-z]+"),
        count(value, r"[^.]+"),
        count(value, r"[^\x20()/-]+"),
        F.size(groups),
        F.coalesce(F.array_max(groups), F.lit(0)),
        F.coalesce(F.array_min(groups), F.lit(0)),
        flag(F.length(number).between(2, 40) & luhn(number)),
        flag(_valid("ip", value)),
        flag(value.rlike(r"(?i)@|\bat\b")),
        flag(value.rlike(r"(?i)[A-Za-z0-9](?:\.|[\x20\[(]+dot[\x20\])]+)[A-Za-z]{2,}$")),
        flag(value.startswith("+") | value.startswith("(")),
        flag(left.rlike("[0-9A-Za-z][.:/,-]?$")),
        flag(right.rlike("^[.:/,-]?[0-9A-Za-z]")),
        count(left, "[^0-9]+"),
        count(right, "[^0-9]+"),
        flag(left.rlike(r"(?i)(?:mail|phone|tel|call|card|visa|addr|contact|ip)\W*$")),
        F.size(F.array_distinct(F.split(number, ""))),
    ]
    return [column.cast("double") for column in columns]


def _rewritten(kind: str, value: Column) -> list[Column]:
    """Looser forms of a base span that still are personal data."""
    if kind == "email":
        return [F.regexp_replace(F.regexp_replace(value, "@", " at "), r"\.", " dot "), F.regexp_replace(value, "@", "(at)")]
    if kind == "card":
        number = digits(value)
        return [F.regexp_replace(number, "(.{4})(?=.)", r"$1."), F.regexp_replace(number, "(.{4})(?=.)", "$1  ")]
    if kind == "phone":
        return [F.regexp_replace(value, r"^\+[0-9]{1,3}[\x20-]?", ""), F.regexp_replace(value, r"^\+", "")]
    return []


def _broken(kind: str, value: Column) -> list[tuple[str, Column]]:
    """Texts of a like shape that are no personal data, with the kind whose generator proposes them."""
    number = digits(value)
    if kind == "card":
        last = ((F.right(number, F.lit(1)).cast("int") + 1) % 10).cast("string")
        wrong = F.concat(F.left(number, F.length(number) - 1), last)
        forms = [wrong, *[F.regexp_replace(wrong, "(.{4})(?=.)", f"$1{mark}") for mark in (" ", ".", "  ", "-")]]
        pairs = [F.regexp_replace(F.left(number, F.lit(n)), "(.{2})(?=.)", "$1 ") for n in (10, 12, 14)]
        dates = [
            F.regexp_replace(F.left(number, F.lit(n)), "^(.{4})(..)(..)", f"$1{mark}$2{mark}$3 ")
            for n in (10, 12)
            for mark in "-./"
        ]
        runs = [F.left(number, F.lit(n)) for n in (10, 11, 12, 13)]
        return [("card", x) for x in forms + pairs + dates + runs] + [
            ("phone", x) for x in [number, wrong, *forms, *pairs, *dates, *runs]
        ]
    if kind == "ip":
        return [("ip", F.concat(value, F.lit(".7"))), ("ip", F.regexp_replace(value, r"^[0-9]+", "731")), ("card", value), ("phone", value)]
    if kind == "phone":
        bare = F.regexp_replace(value, r"^\+", "")
        return [("card", x) for x in (bare, number, F.regexp_replace(bare, r"[()]", ""), F.regexp_replace(bare, r"^[0-9]{1,3}[\x20-]?", ""))]
    plain = F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z.@]|(?<=@)[^.]*\.", ""), r"\.(?=[^@]*@)", "")
    return [
        ("email", F.regexp_replace(F.regexp_replace(plain, "@", " at "), r"\.", " dot ")),
        ("email", F.regexp_replace(value, r"\..*$", "")),
    ]


@dataclass(frozen=True)
class Model:
    """Boosted trees as nested tuples, and the score from which a candidate of each kind is taken."""

    trees: tuple
    weights: tuple[float, ...]
    thresholds: dict[str, float]

    def margin(self, inputs: Sequence[Column]) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, limit, low, high = node
            return F.when(inputs[feature] <= limit, walk(low)).otherwise(walk(high))

        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            total = total + walk(tree) * weight
        return total

    def score(self, inputs: Sequence[Column]) -> Column:
        return 1 / (1 + F.exp(-2 * self.margin(inputs)))


def _tree(node) -> tuple | float:
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild()))


def examples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled candidates, each different one once: kind, value, left, right, label."""
    known = _known()
    per_kind = []
    for order, kind in enumerate(KINDS):
        per_kind.append(F.transform(F.col(f"__{kind}"), _example(order, 1.0)))
        proposed = candidates(F.col("__text"), kind, known, F.col("__numeric"))
        against = F.filter(proposed, _disproved(kind))
        per_kind.append(F.transform(against, _example(order, 0.0)))
    return _with_base(docs, id_col, text_col).select(F.explode(F.concat(*per_kind)).alias("s")).select("s.*").distinct()


def _disproved(kind: str):
    return lambda s: disproved(kind, s)


def _example(order: int, label: float):
    return lambda s: F.struct(
        F.lit(float(order)).alias("kind"),
        s["value"].alias("value"),
        s["left"].alias("left"),
        s["right"].alias("right"),
        F.lit(label).alias("label"),
    )


def _with_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    texts = texts.withColumn("__numeric", F.col("__text").rlike(_NUMERIC))
    found = [base(F.col("__text"), kind, F.col("__numeric")).alias(f"__{kind}") for kind in KINDS]
    return texts.select(id_col, "__text", "__numeric", *found)


def _known() -> Column:
    return F.concat(*[F.col(f"__{kind}") for kind in KINDS])


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    rounds: int = 12, depth: int = 4, precision: float = 0.98,
) -> Model | None:
    """Trees and thresholds from all examples; None where the table has no base span."""
    known = saved(examples(docs, id_col, text_col), "pii-examples")  # texts are scanned once
    extra = [known]
    for order, kind in enumerate(KINDS):
        own = known.where((F.col("kind") == order) & (F.col("label") == 1.0))
        forms = [(kind, form, 1.0) for form in _rewritten(kind, F.col("value"))]
        forms += [(of, form, 0.0) for of, form in _broken(kind, F.col("value"))]
        made = F.explode(
            F.array(
                *[
                    F.struct(F.lit(float(KINDS.index(of))).alias("kind"), form.alias("value"), F.lit(label).alias("label"))
                    for of, form, label in forms
                ]
            )
        )
        extra.append(
            own.select("left", "right", made.alias("m")).select("m.kind", "m.value", "left", "right", "m.label")
        )
    rows = extra[0]
    for part in extra[1:]:
        rows = rows.unionAll(part)
    names = [f"f{i}" for i in range(len(features(*[F.col("value")] * 4)))]
    inputs = features(F.col("kind"), F.col("value"), F.col("left"), F.col("right"))
    fold = F.pmod(F.xxhash64(F.regexp_replace("value", "[^0-9A-Za-z]+", "")), F.lit(4))
    alike = ["kind", "label", "fold", *names]
    told = rows.select("kind", "label", fold.alias("fold"), *[c.alias(n) for c, n in zip(inputs, names, strict=True)])
    counted = told.groupBy(*alike).agg(F.count("*").cast("double").alias("weight"))
    # in a fixed order, as sums of fractions and Spark's candidates for splits depend on it
    table = saved(counted.sortWithinPartitions(*alike), "pii-features")
    learn = table.where("fold > 0")
    if learn.agg(F.countDistinct("label")).first()[0] < 2:
        return None
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(learn)
    fitted = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, cacheNodeIds=False, weightCol="weight").fit(vectors)
    trees = tuple(_tree(tree._java_obj.rootNode()) for tree in fitted.trees)
    model = Model(trees, tuple(fitted.treeWeights), {})
    steps = 50
    held = table.where("fold = 0").select(
        "kind", "label", "weight", F.floor(model.score([F.col(n) for n in names]) * steps).cast("int").alias("step")
    )
    good, every = F.sum(F.col("label") * F.col("weight")), F.sum("weight")
    counts = held.groupBy("kind", "step").agg(good.alias("good"), every.alias("all")).collect()
    thresholds = {}
    for order, kind in enumerate(KINDS):
        for step in range(steps // 2, steps):
            own = [r for r in counts if r["kind"] == order and r["step"] >= step]
            good, total = sum(r["good"] for r in own), sum(r["all"] for r in own)
            if total and good >= precision * total:
                thresholds[kind] = step / steps
                break
    return Model(trees, tuple(fitted.treeWeights), thresholds)


def added(text: Column, kind: str, known: Column, numeric: Column, model: Model | None) -> Column:
    """Candidates of one kind that the trees take."""
    if model is None or kind not in model.thresholds:
        return F.array().cast(spans.SPAN)
    number = F.lit(float(KINDS.index(kind)))
    taken = F.filter(
        candidates(text, kind, known, numeric),
        lambda s: let(
            F.array(*features(number, s["value"], s["left"], s["right"])),
            lambda f: model.score([f[i] for i in range(20)]) >= model.thresholds[kind],
        ),
    )
    return F.transform(taken, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def find(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``base`` and ``added`` spans with kind and offsets."""
    told, more = [], []
    for order, kind in enumerate(KINDS):
        told.append(spans.tagged(F.col(f"__{kind}"), kind, order))
        more.append(spans.tagged(added(F.col("__text"), kind, _known(), F.col("__numeric"), model), kind, order))
    with_base = _with_base(docs, id_col, text_col)
    return with_base.select(id_col, F.concat(*told).alias("base"), F.concat(*more).alias("added"))
