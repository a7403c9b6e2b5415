"""What monitoring reads: text exposition and statistics. They hold names and numbers, never values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.types import NAMES
from veilframe.operators import metrics


def exposition(counts: DataFrame, name: str, labels: list[str], value: str = "n", kind: str = "counter", help_: str = "") -> DataFrame:
    """(line): a metric family in the text exposition format, header lines first."""
    quoted = [F.concat(F.lit(f'{c}="'), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r'(["\\])', r"\\$1"), F.lit('"')) for c in labels]
    body = F.concat(F.lit("{"), F.concat_ws(",", *quoted), F.lit("}")) if labels else F.lit("")
    lines = counts.select(F.lit(2).alias("k"), F.concat(F.lit(name), body, F.lit(" "), F.col(value).cast("string")).alias("line"))
    head = counts.sparkSession.createDataFrame([(0, f"# HELP {name} {help_}"), (1, f"# TYPE {name} {kind}")], "k int, line string")
    return head.unionByName(lines).orderBy("k", "line").select("line")


def latency(requests: DataFrame, name: str = "veilframe_latency_ms") -> DataFrame:
    """(line): the latency histogram: cumulative buckets, sum and count."""
    buckets = metrics.histogram(requests, "latency_ms").select(F.coalesce(F.col("le").cast("string"), F.lit("+Inf")).alias("le"), F.col("cumulative").cast("long").alias("n"))
    whole = requests.agg(F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("s"), F.count("latency_ms").alias("c"))
    ends = whole.select(F.explode(F.array(F.concat(F.lit(f"{name}_sum "), F.col("s").cast("string")), F.concat(F.lit(f"{name}_count "), F.col("c").cast("string")))).alias("line"))
    return exposition(buckets, f"{name}_bucket", ["le"], kind="histogram", help_="milliseconds of a request").unionByName(ends)


def latency_by_operation(requests: DataFrame, name: str = "veilframe_operation_latency_ms") -> DataFrame:
    """(line): cumulative buckets by operation, from one pass."""
    op = metrics.closed(F.col("op"), metrics.OPERATIONS).alias("op")
    upto = [F.count(F.when(F.col("latency_ms") <= b, 1)).alias(str(b)) for b in metrics.BOUNDS]
    counted = requests.groupBy(op).agg(*upto, F.count("latency_ms").alias("+Inf"))
    ends = [str(b) for b in metrics.BOUNDS] + ["+Inf"]
    long = counted.select("op", F.explode(F.array(*[F.struct(F.lit(e).alias("le"), F.col(f"`{e}`").alias("n")) for e in ends])).alias("x")).select("op", "x.*")
    return exposition(long, f"{name}_bucket", ["op", "le"], kind="histogram", help_="milliseconds of a request by operation")


def store_families(decisions: DataFrame) -> list[DataFrame]:
    """The families of the mapping store, from what was decided (operation, and `stored` for masks that were kept)."""
    kinds = {"puts": ("mask", "mappings stored"), "skipped": ("mask", "masks without a mapping"), "hits": ("demask", "originals given back"), "repeats": ("again", "earlier masks given again"), "misses": ("echo", "masked payloads without a mapping")}
    out = []
    for name, (op, help_) in kinds.items():
        hit = F.col("operation") == op
        if op == "mask":
            hit = hit & (F.col("stored") if name == "puts" else ~F.col("stored"))
        out.append(exposition(decisions.agg(F.count(F.when(hit, 1)).alias("n")), f"veilframe_store_{name}_total", [], help_=help_))
    return out


def token_families(tokens: DataFrame, seconds: int = 10) -> list[DataFrame]:
    """Tokens received and given (ts, tokens_in, tokens_out), and the last rates of requests and tokens a second."""
    total = lambda c: tokens.agg(F.coalesce(F.sum(c), F.lit(0)).alias("n"))
    last = F.max("ts").alias("end")
    recent = tokens.join(F.broadcast(tokens.agg(last)), F.col("ts") > F.col("end") - F.make_dt_interval(secs=F.lit(seconds)))  # one row
    rate = recent.agg((F.count("*") / seconds).alias("rps"), (F.coalesce(F.sum(F.col("tokens_in") + F.col("tokens_out")), F.lit(0)) / seconds).alias("tps"))
    return [
        exposition(total("tokens_in"), "veilframe_tokens_in_total", [], help_="estimated tokens received"),
        exposition(total("tokens_out"), "veilframe_tokens_out_total", [], help_="estimated tokens given"),
        exposition(rate, "veilframe_requests_per_second", [], "rps", kind="gauge", help_="requests a second, lately"),
        exposition(rate, "veilframe_tokens_per_second", [], "tps", kind="gauge", help_="tokens a second, lately"),
    ]


def families(requests: DataFrame, masked: DataFrame, leaks: DataFrame | None = None, evicted: DataFrame | None = None, decisions: DataFrame | None = None, tokens: DataFrame | None = None) -> list[DataFrame]:
    """The metric families of traffic (ts, system_id, op, status, latency_ms) and of what was masked (system_id,
    replacements), each a table of lines; labels come from closed sets and none holds a value."""
    by = lambda df, *c: df.groupBy(*c).agg(F.count("*").alias("n"))
    known = [F.lit(t) for t in NAMES]
    kinds = masked.select("system_id", F.explode("replacements.type").alias("type")).withColumn("type", F.when(F.col("type").isin(known), F.col("type")).otherwise("custom"))
    quantiles = metrics.sketch_quantiles(metrics.sketch(requests, "latency_ms", ["system_id"]), ["system_id"], [0.5, 0.9, 0.95, 0.99, 1.0])
    changed = masked.select("system_id", (F.size("replacements") > 0).alias("changed"))
    out = [
        exposition(metrics.request_counts(requests), "veilframe_requests_total", ["op", "status"], help_="requests by operation and status"),
        exposition(by(requests, "system_id"), "veilframe_system_requests_total", ["system_id"], help_="requests by system"),
        exposition(by(requests.where("status >= 400"), "status"), "veilframe_errors_total", ["status"], help_="failed requests"),
        latency(requests),
        latency_by_operation(requests),
        exposition(quantiles, "veilframe_latency_quantile_ms", ["system_id", "quantile"], "estimate", kind="gauge", help_="milliseconds by quantile, within one percent"),
        exposition(by(kinds, "type"), "veilframe_found_total", ["type"], help_="replacements by category"),
        exposition(by(kinds, "system_id", "type"), "veilframe_system_found_total", ["system_id", "type"], help_="replacements by system and category"),
        exposition(by(changed, "changed"), "veilframe_payloads_total", ["changed"], help_="payloads by whether masking changed them"),
    ]
    if leaks is not None:
        out.append(exposition(by(leaks.select(F.explode("leaks.type").alias("type")), "type"), "veilframe_leaks_total", ["type"], help_="values found in masked texts"))
    if evicted is not None:
        out.append(exposition(evicted.agg(F.count("*").alias("n")), "veilframe_evicted_total", [], help_="entries dropped for room"))
    out += store_families(decisions) if decisions is not None else []
    out += token_families(tokens) if tokens is not None else []
    return out


def stats(**tables: DataFrame) -> DataFrame:
    """One row `json`: each table's rows as a list under its name. Tables are aggregates of bounded size."""
    part = lambda name, t: t.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*t.columns)))).alias("v")).select(F.concat(F.lit(f'"{name}":'), F.col("v")).alias("part"))
    parts = reduce(lambda a, b: a.unionByName(b), [part(name, t) for name, t in tables.items()])
    return parts.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("part")), ","), F.lit("}")).alias("json"))
