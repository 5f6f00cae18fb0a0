"""Entity resolution and staged matching of record keys to a gazetteer."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.operators.components import components
from tallystone.operators.panel import first_rows
from tallystone.operators.skew import salted_join
from tallystone.session import cut_lineage


def entity_map(keys: DataFrame, key_id: str, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cluster id of every key; a key without a pair is its own cluster."""
    clusters = components(pairs, a, b)
    joined = keys.select(key_id).join(clusters, F.col(key_id) == F.col("node"), "left")
    return joined.select(key_id, F.coalesce("component", key_id).alias("canonical_id"))


def canonical_names(records: DataFrame, cluster: str, recency: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Most recent record per cluster, its columns renamed (``column -> canonical name``)."""
    latest = first_rows(records.select(cluster, *dict.fromkeys([*recency, *columns])), [cluster], recency, last=True)
    return latest.select(cluster, *[F.col(c).alias(n) for c, n in columns.items()])


def name_variants(df: DataFrame, place: Sequence[str], name: str) -> DataFrame:
    """Places that carry more than one name: one row per place and name.

    Rows rather than arrays, so a place with very many names is no burden.
    """
    names = df.select(*place, name).where(F.col(name).isNotNull()).distinct()
    several = names.groupBy(*place).agg(F.count("*").alias("n_names")).where("n_names > 1")
    return salted_join(names, several, place, [name])


def compare_sources(a: DataFrame, b: DataFrame, place: Sequence[str], name: str, labels: tuple[str, str]) -> DataFrame:
    """Names per place in two sources: which source has the name, and whether both have the place."""
    la, lb = labels
    tagged = a.select(*place, name, F.lit(True).alias(la), F.lit(False).alias(lb)).unionByName(
        b.select(*place, name, F.lit(False).alias(la), F.lit(True).alias(lb)))
    names = tagged.groupBy(*place, name).agg(F.max(la).alias(f"in_{la}"), F.max(lb).alias(f"in_{lb}"))
    places = names.groupBy(*place).agg(
        (F.max(f"in_{la}") & F.max(f"in_{lb}")).alias("place_in_both"), F.count("*").alias("n_names"))
    return salted_join(names, places, place, [name])


def cascade(df: DataFrame, key: str, rules: Mapping[str, tuple[Column, DataFrame, str, str]], out: str = "match",
            rule: str = "match_rule") -> DataFrame:
    """Match through rules in order, the first that succeeds wins.

    A rule is ``(key expression, table, table key, table value)``. Each table is
    reduced to one row per key (least value). Only rows still unmatched take part
    in a later rule; the others carry no key into it.
    """
    cur = df.withColumns({out: F.lit(None), rule: F.lit(None).cast("string")})
    first = True
    for name, (expr, table, table_key, value) in rules.items():
        lookup = table.where(F.col(table_key).isNotNull()).groupBy(F.col(table_key).alias("_k")).agg(F.min(value).alias("_v"))
        open_key = expr if first else F.when(F.col(out).isNull(), expr)
        joined = salted_join(cur.withColumn("_k", open_key), lookup, ["_k"], [key], "left")
        found = F.col("_v") if first else F.coalesce(out, "_v")
        cur = joined.withColumn(rule, F.when(F.col(rule).isNotNull(), F.col(rule)).when(F.col("_v").isNotNull(), name))
        cur = cur.withColumn(out, found).drop("_k", "_v")
        first = False
    return cur


def candidate_status(records: DataFrame, record: str, gazetteer: DataFrame, ident: str, keys: Sequence[str]) -> DataFrame:
    """Candidate count per record on the match key: unmatched, unique or ambiguous.

    Records of one key share their candidates, so the candidates are counted per
    key and attached many-to-one instead of pairing every record with each.
    """
    counted = gazetteer.groupBy(*keys).agg(F.countDistinct(ident).alias("n_geo"), F.min(ident).alias("_only"))
    joined = salted_join(records, counted, keys, [record], "left")
    n = F.coalesce("n_geo", F.lit(0).cast("long"))
    return joined.withColumns({
        "n_geo": n,
        "match_status": F.when(n == 0, "unmatched").when(n == 1, "unique").otherwise("ambiguous"),
        ident: F.when(n == 1, F.col("_only"))}).drop("_only")


Stage = Callable[[DataFrame], DataFrame]


def narrowed(gazetteer: DataFrame, ident: str, keys: Sequence[str], record: str) -> Stage:
    """Stage: the record's own attributes join the key; a single remaining candidate resolves it."""

    def run(open_records: DataFrame) -> DataFrame:
        counted = gazetteer.groupBy(*keys).agg(F.countDistinct(ident).alias("_n"), F.min(ident).alias(ident))
        found = salted_join(open_records.drop(ident), counted.where("_n = 1"), keys, [record])
        return found.select(record, ident)

    return run


def preferred(gazetteer: DataFrame, ident: str, keys: Sequence[str], rank: Column, record: str) -> Stage:
    """Stage: candidates of the best rank win when there is exactly one of them."""

    def run(open_records: DataFrame) -> DataFrame:
        ranked = gazetteer.groupBy(*keys, rank.alias("_rank")).agg(
            F.countDistinct(ident).alias("_n"), F.min(ident).alias(ident))
        best = ranked.groupBy(*keys).agg(F.min_by(F.struct("_n", ident), "_rank").alias("_b")).where("_b._n = 1")
        best = best.select(*keys, F.col(f"_b.{ident}").alias(ident))
        return salted_join(open_records.drop(ident), best, keys, [record]).select(record, ident)

    return run


def resolve(records: DataFrame, record: str, ident: str, stages: Mapping[str, Stage]) -> DataFrame:
    """Run stages over the records that are still open; each stage only sees those.

    ``records`` has ``match_status`` from ``candidate_status``. Between stages the
    open set is written to the checkpoint folder. Rows that no stage resolves keep
    the status they came with.
    """
    open_records = records.where("match_status = 'ambiguous'")
    done = records.where("match_status <> 'ambiguous'").select(record, "match_status", ident)
    for name, stage in stages.items():
        open_records = cut_lineage(open_records)
        found = stage(open_records).withColumn("match_status", F.lit(name))
        done = done.unionByName(found)
        open_records = open_records.join(found.select(record), record, "left_anti")
    rest = open_records.select(record, "match_status", ident)
    final = done.unionByName(rest).withColumnsRenamed({"match_status": "_status", ident: "_ident"})
    return records.drop("match_status", ident).join(final, record).withColumnsRenamed(
        {"_status": "match_status", "_ident": ident})


def rounds(records: DataFrame, record: str, matchers: Mapping[str, Callable[[DataFrame], DataFrame]], ident: str,
           dropped: DataFrame | None = None) -> DataFrame:
    """Match and ``round`` of every record; each round sees only what the rounds before it left.

    A matcher maps the open records to (record, ident) rows; the least ident of a record counts.
    Records of the drop-list are in no round and not in the result.
    """
    records = records if dropped is None else records.join(dropped.select(record), record, "left_anti")
    open_records, done = records, None
    for name, match in matchers.items():
        open_records = cut_lineage(open_records)
        found = cut_lineage(match(open_records).groupBy(record).agg(F.min(ident).alias(ident)).withColumn("round", F.lit(name)))
        done = found if done is None else done.unionByName(found)
        open_records = open_records.join(found, record, "left_anti")
    return records.join(done, record, "left")


def coverage(matched: DataFrame) -> DataFrame:
    """Records per round (NULL: none) and their share of all records, in per cent."""
    counts = matched.groupBy("round").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.bround(100 * F.col("n") / matched.agg(F.count("*")).scalar(), 2))
