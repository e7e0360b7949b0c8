"""Secret scan over an incremental ledger of blobs.

Every version of every text is addressed by its content. The ledger, a Parquet table in a shared folder, says
which (blob, rule version) pairs were scanned and what was found; a run scans only pairs that it does not hold,
appends them, and joins findings back to all paths that show a blob. Changing a rule means giving it a new
version: only that rule is run again, and over each distinct blob once, however many paths show it.

Rows: NULL text is the empty text. A repeated path, text or row gives one result row each; equal texts share one
blob. An empty table gives an empty ledger. Only the id and text columns are read; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .common import fresh, let, saved

FINDINGS = "array<struct<rule:string,start:bigint,order:int,end:bigint,kind:string>>"
LEDGER = f"blob binary, rules array<string>, findings {FINDINGS}"


#: blobs with findings that a broadcast may hold
BROADCAST_ROWS = 50_000


@dataclass(frozen=True)
class Rule:
    """A pattern with a version. ``hints``: lower-case texts of which a match must hold one, whatever its case."""

    kind: str
    pattern: str
    version: int = 1
    hints: tuple[str, ...] = ()
    least: int = 1
    group: int = 0
    keep: Callable[[Column], Column] | None = field(default=None, compare=False)

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: Column, lowered: Column) -> Column:
        hint = None
        for part in self.hints:
            hint = lowered.contains(part) if hint is None else hint | lowered.contains(part)
        return spans.matches(
            text,
            self.pattern,
            lambda value: (F.length(value) >= self.least) & (self.keep(value) if self.keep else F.lit(True)),
            self.group,
            hint,
        )


_VALUE = "[A-Za-z0-9+/_.=-]"

# fixed values: published forms of credentials
RULES: tuple[Rule, ...] = (
    Rule(
        "assign",
        rf"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?({_VALUE}++)""",
        hints=("password", "passwd", "secret", "token", "apikey", "api_key"),
        least=6,
        group=2,
    ),
    Rule("access", r"AKIA[A-Z0-9]++", hints=("akia",), least=20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+"),
    Rule(
        "private_key",
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?",
        hints=("private key-----",),
    ),
    Rule("jwt", r"(?<![\w-])eyJ[\w-]{8,}+\.eyJ[\w-]{8,}+\.[\w-]{8,}+", hints=("eyj",)),
    Rule("forge", r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}+|glpat-[\w-]{20,}+)", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-")),
    Rule("chat", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+", hints=("xox",)),
    Rule("cloud_key", r"(?<![\w-])AIza[\w-]{35}(?![\w-])", hints=("aiza",)),
    Rule("url_login", r"(?<=://)[^\s:/@]{1,64}:[^\s/@]{3,64}(?=@[A-Za-z0-9])", hints=("://",)),
)


def _key_array(rules: Sequence[Rule]) -> Column:
    return F.array(*[F.lit(rule.key) for rule in rules]).cast("array<string>")


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every version of every path with the address of its content."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("path"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def read_ledger(spark: SparkSession, ledger_dir: str) -> DataFrame:
    """All rows of a ledger; a folder that is not there yet is an empty one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger_dir)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger_dir)


def unseen(found: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Distinct blobs with the keys of the rules that have not seen them.

    Copies fold on the map side, so a blob that holds a third of all rows is sent once per task.
    """
    blobs = found.groupBy("blob").agg(F.first("text").alias("text"))
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    todo = F.array_except(_key_array(rules), F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)


def scan(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Ledger rows of blobs: each rule in ``todo`` run over the whole text."""
    text = F.col("text")
    lowered = blobs.withColumn("lowered", F.lower(text))

    def findings(order: int, rule: Rule) -> Column:
        told = F.transform(
            spans.tagged(rule.spans(text, F.col("lowered")), rule.kind, order),
            lambda s: F.struct(
                F.lit(rule.key).alias("rule"),
                s["start"].alias("start"),
                s["order"].alias("order"),
                s["end"].alias("end"),
                s["kind"].alias("kind"),
            ),
        )
        return F.when(F.array_contains("todo", rule.key), told).otherwise(F.array().cast(FINDINGS))

    found = [findings(order, rule) for order, rule in enumerate(rules)]
    return lowered.select("blob", F.col("todo").alias("rules"), F.concat(*found).alias("findings"))


def update(spark: SparkSession, docs: DataFrame, ledger_dir: str, rules: Sequence[Rule] = RULES, **columns) -> DataFrame:
    """Scan what the ledger has not seen, append it, and return the ledger as it is then."""
    todo = unseen(versions(docs, **columns), read_ledger(spark, ledger_dir), rules)
    scan(todo, rules).write.mode("append").parquet(ledger_dir)
    return read_ledger(spark, ledger_dir)


def _found(ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Blobs with findings of the given rules; saved, so that joins deal out both sides anew and can split hot blobs."""
    known = _key_array(rules)
    found = ledger.groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))
    own = F.filter("findings", lambda s: F.array_contains(known, s["rule"]))
    return saved(found.select("blob", own.alias("findings")).where(F.size("findings") > 0), "findings")


def by_path(docs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", **columns) -> DataFrame:
    """One row per path and version: ``blob`` and the findings of the given rules in it."""
    none = F.array().cast(FINDINGS)
    return (
        versions(docs, id_col, **columns)
        .drop("text")
        .join(_found(ledger, rules), "blob", "left")
        .select(F.col("path").alias(id_col), "blob", F.coalesce("findings", none).alias("findings"))
    )


def redacted(docs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """All columns of the documents, with findings in the text replaced by marks.

    Blobs with findings are broadcast while they are at most ``BROADCAST_ROWS``, else joined by blob.
    """
    key, spans_of = fresh("__blob", docs.columns), fresh("__findings", docs.columns)
    found = _found(ledger, rules).withColumnsRenamed({"blob": key, "findings": spans_of})
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    blob = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    clean = F.when(F.col(spans_of).isNull(), F.col(text_col)).otherwise(redact(F.col(text_col), F.col(spans_of)))
    return (
        docs.withColumn(key, blob)
        .join(found, key, "left")
        .select(*[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns])
    )


def redact(text: Column, findings: Column, mark: str = "<secret>") -> Column:
    """The text with every found span, overlapping ones joined, replaced by a mark."""
    merged = F.aggregate(
        F.array_sort(F.transform(findings, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))),
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["start"] <= F.element_at(done, -1)["end"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )

    def cut(spans_: Column) -> Column:
        starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans_, lambda s: s["end"]))
        ends = F.concat(F.transform(spans_, lambda s: s["start"]), F.array(F.length(text).cast("long")))
        return F.array_join(
            F.transform(
                F.arrays_zip(starts.alias("a"), ends.alias("b")),
                lambda z: F.substring(text, (z["a"] + 1).cast("int"), (z["b"] - z["a"]).cast("int")),
            ),
            mark,
        )

    return F.when(F.size(findings) == 0, text).otherwise(let(merged, cut))
