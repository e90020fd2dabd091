"""Tenant store operators: views, audit chains, versions, checks.

Isolation here is a filter that callers keep to, not a security boundary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.scratch import written

GENESIS = "0" * 64


def tenant_view(df: DataFrame, tenant: str | int | None, tenant_col: str = "tenant_id") -> DataFrame:
    """The tenant's rows; no tenant, no rows."""
    return df.filter(F.lit(False)) if tenant is None else df.filter(F.col(tenant_col) == F.lit(tenant))


def tenant_subtree(tenants: DataFrame, path: str | None, path_col: str = "path") -> DataFrame:
    """A tenant and those below it, by materialised path; never those above or beside."""
    if not path:
        return tenants.filter(F.lit(False))
    return tenants.filter((F.col(path_col) == path) | F.startswith(F.col(path_col), F.lit(path.rstrip("/") + "/")))


def visible_counts(tenants: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, n_below): how many tenants each one sees, itself included.

    A tenant's ancestors are the prefixes of its own path, so this is one aggregate over
    (depth) rows a tenant, not a join on a range.
    """
    parts = F.split(F.col(path_col), "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return tenants.select(F.explode(above).alias(path_col)).groupBy(path_col).agg(F.count(F.lit(1)).alias("n_below"))


#: Blocks of a level that make one of the next, in the labels of a tree.
FAN = 16


def tree_labels(tenants: DataFrame, path_col: str = "path") -> DataFrame:
    """``tenants`` with low and high: a tenant's place in the order of paths, and the last place below it.

    So "sees" is a range of whole numbers.  Places are counted by sorted ranges of paths, each a
    partition of its own, with the sizes of the ranges before it added: no task holds all tenants.
    The sorted paths are written to the shared folder, as each further step must see the same ranges.
    """
    key = F.concat(F.col(path_col), F.lit("/"))
    rows = tenants.withColumn("__key", key)
    placed = rows.repartitionByRange("__key").sortWithinPartitions("__key")
    placed = written(placed.withColumn("__id", F.monotonically_increasing_id()), "places")
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(k, 0)
    before = F.get(F.array(*[F.lit(x).cast("long") for x in starts or [0]]), part.cast("int"))
    placed = placed.withColumn("low", before + at)
    parts = F.split(F.col(path_col), "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    last = placed.select("low", F.explode(above).alias(path_col)).groupBy(path_col).agg(F.max("low").alias("high"))
    return placed.select(*tenants.columns, "low").join(last, path_col).select(*tenants.columns, "low", "high")


def _at_level(level: int) -> Callable[[Column], Column]:
    return lambda i: F.struct(F.lit(level).alias("level"), i.alias("block"))


def _levels(top: int) -> int:
    n = 1
    while FAN**n <= top:
        n += 1
    return n


def visible_rows(viewers: DataFrame, rows: DataFrame, top: int) -> DataFrame:
    """Each row (place, ...) with each viewer (low, high, ...) that sees it; ``top``: the highest place.

    A range of places is cut into the fewest blocks of FAN to the power of 0, 1, 2, ... places that
    begin at their multiples; a place lies in one block of each size.  So the join is on equal blocks,
    exact without another test, and a viewer of all places is a few blocks.
    """
    levels, blocks = _levels(top), []
    low, high = F.col("low"), F.col("high")
    first = lambda k: F.ceil(low / F.lit(FAN**k)).cast("long")
    last = lambda k: F.floor((high + 1) / F.lit(FAN**k)).cast("long") - 1
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    for level in range(levels):
        a, b, c, d = first(level), last(level), first(level + 1), last(level + 1)
        own = F.when(c <= d, F.concat(upto(a, F.least(b, c * FAN - 1)), upto(F.greatest(a, (d + 1) * FAN), b))).otherwise(upto(a, b))
        blocks.append(F.transform(own, _at_level(level)))
    seen = viewers.withColumn("__b", F.explode(F.concat(*blocks))).select(*[c for c in viewers.columns if c not in ("low", "high")], "__b.level", "__b.block")
    at = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("place") / F.lit(FAN**k)).cast("long").alias("block")) for k in range(levels)])
    placed = rows.withColumn("__b", F.explode(at)).select(*[c for c in rows.columns if c != "place"], "__b.level", "__b.block")
    return placed.join(seen, ["level", "block"]).drop("level", "block")


def foreign_rows(df: DataFrame, tenant: str | int | None, tenant_col: str = "tenant_id") -> DataFrame:
    """Rows that a write by this tenant must not hold."""
    return df.filter(~F.coalesce(F.col(tenant_col) == F.lit(tenant), F.lit(False)))


def audit_digest(prev_hash: Column, tenant: Column, seq: Column, ts: Column, actor: Column, source_ip: Column, action: Column, object_type: Column, object_id: Column, old_value: Column, new_value: Column, result: Column) -> Column:
    """SHA-256 of an audit row's fields joined by pipes; times in UTC with microseconds."""
    told = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    parts = [prev_hash, tenant.cast("string"), seq.cast("string"), told, actor, F.coalesce(source_ip, F.lit("")), action, object_type]
    parts += [F.coalesce(x, F.lit("")) for x in (object_id, old_value, new_value)] + [result]
    return F.sha2(F.concat(*[y for x in parts for y in (x, F.lit("|"))][:-1]), 256)


_FIELDS = ("actor", "source_ip", "action", "object_type", "object_id", "old_value", "new_value", "result")


def build_audit_chain(rows: DataFrame, *, tenant_col: str = "tenant_id", ts_col: str = "ts", order_cols: tuple[str, ...] = (), heads: DataFrame | None = None) -> DataFrame:
    """``rows`` with seq, prev_hash and hash; behind the stored ``heads`` (see chain_heads()) where a tenant has one.

    A hash depends on the one before it, so each tenant's chain is one sequence.
    Rows are dealt by tenant, sorted, and read as a stream that keeps one hash; a stored head
    comes as a row in front of its tenant's.  They are dealt by a hash of the tenant: were it the
    tenant itself, Spark would leave the exchange out behind a join or grouping by tenant, and
    its adaptive plan may then read that one by mapper, which tears chains apart.
    """
    import hashlib

    import pyarrow as pa

    order = [ts_col, *order_cols]
    src = rows.withColumn("__told", F.date_format(ts_col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).withColumn("__tenant", F.col(tenant_col).cast("string"))
    src = src.withColumn("__seq", F.lit(None).cast("long")).withColumn("__hash", F.lit(None).cast("string"))
    if heads is not None:
        last = heads.select(F.col(tenant_col), F.col(tenant_col).cast("string").alias("__tenant"), F.col("seq").alias("__seq"), F.col("hash").alias("__hash"))
        src = src.unionByName(last.dropna(subset=[tenant_col, "__seq"]), allowMissingColumns=True)
    dealt = src.select(*rows.columns, "__told", "__tenant", "__seq", "__hash").repartition(F.xxhash64(tenant_col)).sortWithinPartitions(tenant_col, F.asc_nulls_last("__seq"), *order)

    def chain(batches):
        now, seq, last = None, 0, GENESIS
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n in (*_FIELDS, "__told", "__tenant", "__seq", "__hash")}
            seqs, prevs, hashes, own = [], [], [], []
            for k in range(batch.num_rows):
                if cols["__seq"][k] is not None:
                    now, seq, last = cols["__tenant"][k], cols["__seq"][k], cols["__hash"][k]
                    continue
                if cols["__tenant"][k] != now:
                    now, seq, last = cols["__tenant"][k], 0, GENESIS
                own.append(k)
                seq += 1
                told = [last, now, str(seq), cols["__told"][k], *[cols[f][k] or "" for f in _FIELDS]]
                prevs.append(last)
                last = hashlib.sha256("|".join(told).encode()).hexdigest()
                seqs.append(seq)
                hashes.append(last)
            batch = batch if len(own) == batch.num_rows else batch.take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seqs, pa.int64()), pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], names=[*batch.schema.names, "seq", "prev_hash", "hash"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInArrow(chain, f"{schema}, seq long, prev_hash string, hash string").drop("__told", "__tenant", "__seq", "__hash")


def chain_heads(chain: DataFrame, tenant_col: str = "tenant_id") -> DataFrame:
    """(tenant, seq, hash): the last row of each chain, from which it goes on."""
    return chain.groupBy(tenant_col).agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))


def chain_faults(chain: DataFrame, tenant_col: str = "tenant_id") -> DataFrame:
    """(tenant, seq, fault) of each row that breaks its chain: repeated, gap, link or digest (the first that holds).

    A row meets the row before it by tenant and number, so a chain is dealt over all tasks, however
    long it is; a number that comes twice is one row of the other side, so nothing is doubled.
    """
    digest = audit_digest(F.col("prev_hash"), F.col(tenant_col), F.col("seq"), F.col("ts"), *[F.col(f) for f in _FIELDS])
    rows = chain.select(tenant_col, "seq", "prev_hash", (F.col("hash") == digest).alias("__whole"), "hash")
    each = rows.groupBy(tenant_col, "seq").agg(F.count(F.lit(1)).alias("__n"), F.min("prev_hash").alias("__prev"), F.bool_and(F.coalesce("__whole", F.lit(False))).alias("__whole"), F.max("hash").alias("__hash"))
    before = each.select(tenant_col, (F.col("seq") + 1).alias("seq"), F.col("__hash").alias("__last"), F.lit(True).alias("__there"))
    both = each.join(before, [tenant_col, "seq"], "left")
    first = F.col("seq") == 1
    fault = (
        F.when(F.col("__n") > 1, F.lit("repeated"))
        .when(F.col("seq").isNull() | (~first & F.col("__there").isNull()), F.lit("gap"))
        .when(~F.coalesce(F.col("__prev") == F.when(first, F.lit(GENESIS)).otherwise(F.col("__last")), F.lit(False)), F.lit("link"))
        .when(~F.col("__whole"), F.lit("digest"))
    )
    return both.select(tenant_col, "seq", fault.alias("fault")).filter("fault IS NOT NULL")


def verify_audit_chain(chain: DataFrame, tenant_col: str = "tenant_id") -> DataFrame:
    """One row per tenant: n_rows and first_bad_seq (null if the chain holds)."""
    n = chain.groupBy(tenant_col).agg(F.count(F.lit(1)).alias("n_rows"))
    bad = chain_faults(chain, tenant_col).groupBy(tenant_col).agg(F.min("seq").alias("first_bad_seq"))
    return n.join(bad, tenant_col, "left")


def version_violations(before: DataFrame, after: DataFrame, key: list[str], frozen: list[str], once: list[str]) -> DataFrame:
    """What changed that may not: rows deleted, frozen fields changed, stamps set a second time."""
    old = before.select(*key, *[F.col(c).alias(f"old_{c}") for c in frozen + once], F.lit(True).alias("was"))
    new = after.select(*key, *frozen, *once, F.lit(True).alias("is"))
    both = old.join(new, key, "left")
    changed = [F.when(~F.col(f"old_{c}").eqNullSafe(F.col(c)), F.lit(f"{c} changed")) for c in frozen]
    again = [F.when(F.col(f"old_{c}").isNotNull() & ~F.col(f"old_{c}").eqNullSafe(F.col(c)), F.lit(f"{c} set again")) for c in once]
    why = F.when(F.col("is").isNull(), F.array(F.lit("deleted"))).otherwise(F.array_compact(F.array(*changed, *again)))
    return both.select(*key, F.explode(why).alias("violation"))


def four_eyes_violations(versions: DataFrame, author: str = "author_id", approver: str = "approved_by") -> DataFrame:
    return versions.filter(F.col(author) == F.col(approver))


#: Domains of the store's columns.
DOMAINS = {"severity": ("low", "medium", "high", "critical"), "result": ("success", "failure", "denied"), "evidence_kind": ("snippet", "file", "screenshot")}


def domain_violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per broken check: the row's columns and the check's name.  A null outcome passes, as in SQL."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in sorted(checks.items())]))
    return df.withColumn("violation", F.explode(broken))


def month_partition(ts: Column) -> Column:
    return F.date_format(ts, "yyyy_MM")


def write_incidents(df: DataFrame, path: str, created_col: str = "created_at") -> None:
    """Parquet by month: a filter on the month reads only its folders."""
    df.withColumn("month", month_partition(F.col(created_col))).write.mode("append").partitionBy("month").parquet(path)


def merge_incidents(events: DataFrame, *, tenant_col: str = "tenant_id", key_col: str = "dedup_key", time_col: str = "ts", window_seconds: int = 3600) -> DataFrame:
    """Repeats of a key within ``window_seconds`` of the one before are one incident.

    Row numbers restart where the pause is longer; (tenant, key, first time) names an incident.
    """
    w = Window.partitionBy(tenant_col, key_col).orderBy(time_col)
    pause = F.unix_micros(F.col(time_col).cast("timestamp")) - F.unix_micros(F.lag(time_col).over(w).cast("timestamp"))
    new = F.when(pause.isNull() | (pause > window_seconds * 1_000_000), 1).otherwise(0)
    numbered = events.withColumn("__new", new).withColumn("incident_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(tenant_col, key_col, "incident_no").agg(F.count(F.lit(1)).alias("occurrences"), F.min(time_col).alias("first_seen_at"), F.max(time_col).alias("last_seen_at"))


def latency_histogram(df: DataFrame, seconds_col: str, bounds: tuple[float, ...] | None = None) -> DataFrame:
    """Cumulative counts by upper bound, and all: one row per bound."""
    bounds = bounds or LATENCY_BOUNDS
    counts = df.agg(*[F.count_if(F.col(seconds_col) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(seconds_col).alias("all"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n"))]
    return counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def request_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Requests by method, route, status or what else ``by`` names."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def metrics_text(counts: DataFrame, name: str, by: list[str]) -> DataFrame:
    """A line of the text form that scrapers read for each row of request_counts()."""
    labels = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in by])
    return counts.select(F.concat(F.lit(name + "{"), labels, F.lit("} "), F.col("n").cast("string")).alias("line"))


#: Upper bounds of the latency histogram, in seconds.
LATENCY_BOUNDS = (0.005, 0.025, 0.1, 0.25, 1.0, 2.5, 10.0)


def observed(df: DataFrame, name: str, seconds_col: str, status: Column, statuses: tuple[str, ...]) -> tuple[DataFrame, Observation]:
    """``df``, whose next run also counts requests by status and by latency bound, and where the figures will be: no second pass."""
    o = Observation(name)
    s = F.col(seconds_col)
    counts = [F.count_if(status == x).alias(f"status:{x}") for x in statuses]
    bounds = [F.count_if(s <= b).alias(f"le:{b}") for b in LATENCY_BOUNDS]
    return df.observe(o, *counts, *bounds, F.count(s).alias("le:+Inf"), F.sum(s).alias("sum")), o


def metrics_lines(figures: dict, name: str) -> list[str]:
    """The text form that scrapers read, of figures that observed() gathered: a counter by status, and a cumulative histogram with sum and count."""
    of = lambda kind: [(k.removeprefix(f"{kind}:"), v) for k, v in figures.items() if k.startswith(f"{kind}:")]
    out = [f"# TYPE {name}_total counter"]
    out += [f'{name}_total{{status="{status}"}} {n}' for status, n in of("status")]
    out += [f"# TYPE {name}_seconds histogram"]
    out += [f'{name}_seconds_bucket{{le="{bound}"}} {n}' for bound, n in of("le")]
    return [*out, f"{name}_seconds_sum {figures['sum'] or 0:.3f}", f"{name}_seconds_count {figures['le:+Inf']}"]


class Figures(StreamingQueryListener):
    """What observed() counts in each batch of the streams of a session, added up by the observation's name."""

    def __init__(self) -> None:
        self.total: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            own = self.total.setdefault(name, {})
            for k, v in row.asDict().items():
                own[k] = own.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
