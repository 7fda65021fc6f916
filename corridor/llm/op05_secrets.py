"""Operator 5: incremental ledger of scanned blobs, native functions only.

Every version of a path is addressed by the SHA-256 of its text.  Only (blob,
rule, rule version) triples absent from the ledger are scanned, each blob once
however many paths hold it.  The ledger keeps the spans found: what a scan finds
is written to it first, and all that is told of the paths is read from it, from
earlier runs and this one alike.

Positions come from one walk over the matches: the text is split at the rule's
matches, and a running sum of piece and match lengths gives code point offsets.

Defined results: null text is empty and has no findings; null or repeated ids
each get a row; an empty table gives none; other columns are ignored.  Texts
are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import materialise, settle, table


@dataclass(frozen=True)
class Rule:
    """``value`` is the group whose length must reach ``least``; ``hint`` a cheaper necessary pattern."""

    name: str
    pattern: str
    value: int = 0
    least: int = 1
    version: int = 1
    base: bool = True


#: In the order in which kinds are listed.  For runs of one class, demanding the
#: length in the pattern finds the same matches as dropping the short ones.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
)


def address(versions: DataFrame, text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return versions.withColumn("blob", F.sha2(body.cast("binary"), 256))


def unseen(versions: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """(blob, due): the rules by which each distinct blob has still to be scanned."""
    blobs = versions.groupBy("blob").agg(F.min("path").alias("rep"))
    if ledger is None:
        return blobs.withColumn("due", F.array(*[F.lit(f"{r.name}/{r.version}") for r in rules]))
    seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("/", "rule", "version")).alias("seen"))
    due = F.array_except(F.array(*[F.lit(f"{r.name}/{r.version}") for r in rules]), F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "rep", due.alias("due")).where(F.size("due") > 0)


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, version, start, stop): the accepted matches in (blob, text, due) rows."""
    rows = blobs.withColumn("rid", F.monotonically_increasing_id())
    cases = []
    for r in rules:
        hit = F.array_contains("due", f"{r.name}/{r.version}") & F.col("text").rlike(r.pattern)
        cases.append(F.when(hit, F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"))))
    rows = rows.withColumn("hits", F.array_compact(F.array(*cases))).where(F.size("hits") > 0)
    rows = rows.select("rid", "blob", "text", F.explode("hits").alias("h")).select("rid", "blob", "text", "h.rule", "h.version")

    def by_rule(make) -> F.Column:
        out = None
        for r in rules:
            out = F.when(F.col("rule") == r.name, make(r)) if out is None else out.when(F.col("rule") == r.name, make(r))
        return out

    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    found = rows.select(
        "rid",
        "blob",
        "rule",
        "version",
        by_rule(lambda r: lengths(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)))).alias("size"),
        by_rule(lambda r: lengths(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.value)))).alias("value"),
        by_rule(lambda r: lengths(F.split("text", r.pattern, -1))).alias("before"),
        by_rule(lambda r: F.lit(r.least)).alias("least"),
    )
    parts = found.select("rid", "blob", "rule", "version", "least", F.posexplode(F.arrays_zip("size", "value", "before")).alias("k", "m"))
    parts = parts.where("m.size is not null")  # the piece after the last match
    run = Window.partitionBy("rid", "blob", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("m.before") + F.col("m.size")).over(run)
    return (
        parts.withColumn("stop", stop)
        .where("m.value >= least")
        .select("blob", "rule", "version", (F.col("stop") - F.col("m.size")).cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
    )


def update(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new findings, new ledger rows) for (path, text) versions, given the ledger so far.

    The ledger has a row for each scanned (blob, rule, version), found or not, and its spans.
    """
    v = address(versions.select("path", F.coalesce(F.col("text"), F.lit("")).alias("text")))
    due = unseen(v.select("blob", "path"), rules, ledger)
    chosen = v.join(due.withColumnRenamed("blob", "b"), (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("rep")))
    found = scan(chosen.select("blob", "text", "due"), rules).dropDuplicates(["blob", "rule", "version", "start", "stop"])
    new = due.select("blob", F.explode("due").alias("d")).select("blob", F.split("d", "/")[0].alias("rule"), F.split("d", "/")[1].cast("int").alias("version"))
    spans = found.groupBy("blob", "rule", "version").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    return found, new.join(spans, ["blob", "rule", "version"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")))


def findings(ledger: DataFrame) -> DataFrame:
    """The spans in a ledger's rows, one row for each."""
    return ledger.where(F.size("spans") > 0).select("blob", "rule", "version", F.explode("spans").alias("s")).select("blob", "rule", "version", "s.start", "s.stop")


def earlier(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What the ledger says that the rules, in their present versions, have found in these versions' blobs."""
    now = F.concat_ws("/", "rule", "version").isin(*[f"{r.name}/{r.version}" for r in rules])
    found = findings(ledger.where(now))
    return found.join(address(versions).select("blob"), "blob", "left_semi").distinct()


def summary(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob with findings: counts, the digest of base spans, and all spans."""
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k))])
    base = F.col("rule").isin(*[r.name for r in rules if r.base])
    rows = found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", order[F.col("rule")].alias("kind"), "stop", base.alias("base"), "rule"))).alias("s"))
    say = lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["stop"].cast("string"))
    count = lambda name: F.size(F.filter("s", lambda x: x["rule"] == F.lit(name))).cast("long")
    counts = [count(r.name).alias(f"n_{r.name}") for r in rules if r.base]
    return rows.select(
        "blob",
        *counts,
        F.sha2(F.array_join(F.transform(F.filter("s", lambda x: x["base"]), say), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("s", say), ",").alias("spans"),
    )


def secrets(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; with a ledger only what it lacks is scanned, and what it holds is told too."""
    v = docs.select(F.col(id_col).cast("long").alias("path"), F.col(text_col).alias("text"))
    new = materialise(update(v, RULES, ledger)[1], "ledger")
    found = findings(new)
    if ledger is not None:
        found = found.unionByName(earlier(v, ledger))
    told = materialise(summary(found), "findings")
    paths = address(v).select(F.col("path").alias("doc_id"), "blob")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return paths.join(told, "blob", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{r.name}", F.lit(0).cast("long")).alias(f"n_{r.name}") for r in RULES if r.base],
        F.coalesce("base_sha256", none).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def without_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows in whose text no rule finds anything, with all their columns."""
    found, _ = update(docs.select(F.col(id_col).cast("long").alias("path"), F.col(text_col).alias("text")))
    blobs = settle(docs.sparkSession, lambda: found.select("blob").distinct(), "findings")
    blob = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    # merged, not broadcast: the findings grow with the documents, and the plan is the same at every size
    return docs.join(blobs.hint("merge"), blob == blobs["blob"], "left_anti")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def _sql() -> str:
    kinds = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        kinds.append(
            f"SELECT rid, '{r.name}' AS kind, {k} AS ord, {r.least} AS least, regexp_extract_all(t, '{p}') AS ms, "
            f"regexp_extract_all(t, '{p}', {r.value}) AS gs, string_split_regex(t, '{p}') AS ps FROM d WHERE regexp_matches(t, '{p}')"
        )
    base = ", ".join(f"'{r.name}'" for r in RULES if r.base)
    counts = ", ".join(f"coalesce(n_{r.name}, 0) AS n_{r.name}" for r in RULES if r.base)
    sums = ", ".join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in RULES if r.base)
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        m AS ({" UNION ALL ".join(kinds)}),
        i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
        s AS (SELECT rid, kind, ord, length(ms[i]) AS size, length(gs[i]) AS value, least,
                     list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start
              FROM i),
        f AS (SELECT rid, kind, ord, start, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM s WHERE value >= least),
        g AS (SELECT rid, {sums}, string_agg(span, ',' ORDER BY start, ord) FILTER (kind IN ({base})) AS b,
                     string_agg(span, ',' ORDER BY start, ord) AS spans FROM f GROUP BY rid)
        SELECT doc_id, {counts}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g USING (rid)
    """


QUERIES = {"op5_secrets": op5_secrets}
ORACLES = {"op5_secrets": _sql()}
