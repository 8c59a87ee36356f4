"""Latest rows, as-of rows, top-k, pages, blocked joins and robust statistics over DataFrames."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline.functions.numbers import haversine_m


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a local master gets a temporary one (tests); on
    a cluster that is an error, since its executors share no local folder."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="hearthline-")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))


def latest_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in order; give the id last, so that ties are settled."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def asof_latest(df: DataFrame, keys: list[str], at: str, cutoff: Column, ties: list[str], where: Column | None = None) -> DataFrame:
    """Per key the last row with at <= cutoff that satisfies where; later ties columns win.

    A struct maximum, so that rows are combined before the shuffle and no key is sorted as a whole."""
    seen = df.filter(df[at].isNotNull() & (df[at] <= cutoff))
    seen = seen.filter(where) if where is not None else seen
    rest = [c for c in df.columns if c not in {*keys, at, *ties}]
    best = seen.groupBy(*keys).agg(F.max(F.struct(at, *ties, *rest)).alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in [at, *ties, *rest]))


def asof_first_after(df: DataFrame, keys: list[str], at: str, cutoff: Column, ties: list[str]) -> DataFrame:
    """Per key the first row with at > cutoff."""
    rest = [c for c in df.columns if c not in {*keys, at, *ties}]
    best = df.filter(df[at] > cutoff).groupBy(*keys).agg(F.min(F.struct(at, *ties, *rest)).alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in [at, *ties, *rest]))


def sort_order(field: str, direction: str, fields: dict[str, str], ident: str) -> list[Column]:
    """The order of a requested sort: fields maps the names that may be asked for to columns; unknown values go
    last either way, and the id settles ties."""
    if field not in fields:
        raise ValueError(f"cannot sort by {field!r}; one of {sorted(fields)}")
    if direction not in ("asc", "desc"):
        raise ValueError("a direction is asc or desc")
    column = F.col(fields[field])
    return [column.asc_nulls_last() if direction == "asc" else column.desc_nulls_last(), F.asc(ident)]


def page(df: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """One page of a total order; a top-k per task, merged."""
    if not 1 <= size <= 100:
        raise ValueError("a page has from 1 to 100 rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def left_fan(base: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """base left-joined with tables of one row per key."""
    return reduce(lambda a, b: a.join(b, key, "left"), others, base)


def band_pairs(left: DataFrame, right: DataFrame, x: str, y: str, width: float, condition: Column, on: list[str] | None = None) -> DataFrame:
    """Pairs with |x - y| <= width under condition: y is posted in its own band of that width and its two
    neighbours, so that a plain equi-join on the band meets all of them, each once."""
    a = left.withColumn("_band", F.floor(F.col(x) / width))
    b = right.withColumn("_band", F.explode(F.array(*(F.floor(F.col(y) / width) + k for k in (-1, 0, 1)))))
    return a.join(b, ["_band", *(on or [])]).filter((F.abs(F.col(x) - F.col(y)) <= width) & condition).drop("_band")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], most: int = 200_000, weight: Column | None = None) -> DataFrame:
    """left and right joined on columns of the same names; weight: how many rows a row of either side counts for. A key that makes more than `most` pairs is split: a hash of
    the columns `spread` deals its right rows over parts, and its left rows go to each, so that no task makes all
    pairs of a hot key. Only hot keys are sent to all tasks: one for every `most` pairs at the most. Both sides are
    dealt over a fixed number of tasks, since what is small before the join need not be so after it."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_rows = F.count("*") if weight is None else F.sum(weight)
    sizes = left.groupBy(*on).agg(n_rows.alias("_a")).join(right.groupBy(*on).agg(n_rows.alias("_b")), on)
    hot = sizes.select(*on, F.least(F.col("_b"), F.ceil(F.col("_a") * F.col("_b") / most)).alias("_parts")).filter("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    a = left.join(F.broadcast(hot), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    b = right.join(F.broadcast(hot), on, "left").withColumn("_part", F.pmod(F.xxhash64(*spread), parts)).drop("_parts")
    return a.repartition(n, *on, "_part").join(b.repartition(n, *on, "_part"), [*on, "_part"]).drop("_part")


def dealt(left: DataFrame, right: DataFrame, on: list[str], spread: tuple[Column, Column], most_pairs: int, most_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides' rows of the keys that both have, for a cogroup on `on`, _pa and _pb: a key of more than most_pairs
    pairs, or of about more than most_rows rows on a side, is cut into parts by hashes of `spread`, and each part of left meets
    each part of right once, so that no task holds a hot key."""
    sizes = left.groupBy(*on).agg(F.count("*").alias("_a")).join(right.groupBy(*on).agg(F.count("*").alias("_b")), on)
    by_a, by_b = F.ceil(F.col("_a") / most_rows), F.ceil(F.col("_b") / most_rows)
    parts = sizes.select(*on, by_a.alias("_na"), F.greatest(by_b, F.least("_b", F.ceil(F.col("_a") * F.col("_b") / by_a / most_pairs))).alias("_nb"))
    own = lambda x, n: F.pmod(F.xxhash64(x), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = left.join(parts, on).withColumn("_pa", own(spread[0], "_na")).withColumn("_pb", all_of("_nb"))
    b = right.join(parts, on).withColumn("_pb", own(spread[1], "_nb")).withColumn("_pa", all_of("_na"))
    return a.drop("_na", "_nb"), b.drop("_na", "_nb")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left joined with right on keys, of which nulls are equal; left's keys stay."""
    other = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return left.join(other, reduce(lambda a, b: a & b, (left[k].eqNullSafe(other[f"_k_{k}"]) for k in keys)), how).drop(*(f"_k_{k}" for k in keys))


def running_totals(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], rows_a_chunk: int = 1 << 20, whole: bool = False) -> DataFrame:
    """df with an inclusive running sum along order within keys, for each (name, column) of sums; nulls count as zero.
    With whole, the key's total too, as name_all. Rows that order cannot tell apart get theirs in any turn.

    A key's rows are cut into chunks of about rows_a_chunk along the order, each summed by itself, and what lies in the
    chunks before is added: no task sorts a hot key as a whole. Cuts are the rows whose hash says so, one in
    rows_a_chunk, so that they are the same whenever a lost task is run again, and keys of few rows have none. Cuts and
    chunk totals are sent to all tasks: one row of the order for every rows_a_chunk rows, some 30 MB for 10^12 rows."""
    here = F.struct(*order)
    cuts = df.filter(F.pmod(F.xxhash64(*order), F.lit(rows_a_chunk)) == 0).groupBy(*keys).agg(F.array_sort(F.collect_set(here)).alias("_cuts"))
    cut = same_keys(df, F.broadcast(cuts), keys).withColumn("_chunk", F.coalesce(F.size(F.filter("_cuts", lambda x: x <= here)), F.lit(0)))
    split = cut.filter("_cuts is not null").groupBy(*keys, "_chunk").agg(*(F.sum(c).alias(f"_c_{n}") for n, c in sums.items()))
    each = Window.partitionBy(*keys)
    so_far = each.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = split.select(*keys, "_chunk", *(F.coalesce(F.sum(f"_c_{n}").over(so_far), F.lit(0)).alias(f"_b_{n}") for n in sums), *(F.sum(f"_c_{n}").over(each).alias(f"_t_{n}") for n in sums))
    chunk = Window.partitionBy(*keys, "_chunk")
    inside = chunk.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    along = cut.drop("_cuts").withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    if whole:
        along = along.withColumns({f"{n}_all": F.sum(c).over(chunk) for n, c in sums.items()})
    both = same_keys(along, F.broadcast(before), [*keys, "_chunk"]).withColumns({n: F.col(n) + F.coalesce(f"_b_{n}", F.lit(0)) for n in sums})
    if whole:
        both = both.withColumns({f"{n}_all": F.coalesce(f"_t_{n}", f"{n}_all", F.lit(0)) for n in sums})
    return both.drop("_chunk", *(f"_{x}_{n}" for x in "bt" for n in sums))


def band_totals(left: DataFrame, right: DataFrame, on: list[str], x: str, y: str, width: float, totals: dict[str, Column], out: list[str]) -> DataFrame:
    """Distinct (on, x, out) of left with each total over right's rows of the same `on` with |x - y| <= width.

    No pairs are made: right's totals run along y, and each row of left takes the difference of two places on
    that line, so that the work grows with the rows, however many of them lie together."""
    points = right.groupBy(*on, F.col(y).alias("_at")).agg(*(t.alias(n) for n, t in totals.items())).withColumns({"_kind": F.lit(1), "_sign": F.lit(0)})
    asked = left.select(*on, x, *out).distinct().withColumn("_ends", F.explode(F.array(F.struct(F.lit(0).alias("_kind"), F.lit(-1).alias("_sign")), F.struct(F.lit(2).alias("_kind"), F.lit(1).alias("_sign")))))
    ends = asked.select(*on, x, *out, "_ends.*").withColumn("_at", F.col(x) + F.col("_sign") * width)
    line = points.unionByName(ends, allowMissingColumns=True)
    along = running_totals(line, on, ["_at", "_kind", *out], {f"_run_{n}": n for n in totals}).filter("_sign <> 0")
    return along.groupBy(*on, x, *out).agg(*(F.sum(F.col("_sign") * F.col(f"_run_{n}")).alias(n) for n in totals))


def cell_of(df: DataFrame, lat: str, lon: str, radius_m: float) -> DataFrame:
    """df with the grid cell (_row, _col) of each row's place. Cells are as high as the radius; in each row of cells they
    are as wide as it takes there, and wrap at 180 degrees, so that poles and the date line are no borders."""
    high = radius_m / 110_000
    return df.withColumn("_row", F.floor(F.col(lat) / high)).withColumn("_col", _cell_column(F.col(lon), _cells(F.col("_row"), high)))


def _cells(row: Column, high: float) -> Column:
    """How many cells a row has around the globe: as wide as the radius where the row is narrowest, two rows further
    out, since neighbours count columns by their own row."""
    edge = F.least(F.lit(90.0), (F.greatest(F.abs(row), F.abs(row + 1)) + 2) * high)
    return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / (high * 1.01))).cast("long")


def _cell_column(lon: Column, n: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 360 * n), n)


def cells_near(df: DataFrame, lat: str, lon: str, radius_m: float) -> DataFrame:
    """df in each cell (_row, _col) where a row of cell_of() may lie within the radius: its own and its neighbours."""
    high = radius_m / 110_000
    # Each row's cell count once; rows of fewer than three cells are posted in each of them once.
    at = df.withColumn("_at", F.floor(F.col(lat) / high)).withColumns({f"_n{i}": _cells(F.col("_at") + i, high) for i in (-1, 0, 1)})
    at = at.withColumns({f"_c{i}": _cell_column(F.col(lon), F.col(f"_n{i}")) for i in (-1, 0, 1)})
    post = lambda i, j: F.struct((F.col("_at") + i).alias("_row"), F.pmod(F.col(f"_c{i}") + j, F.col(f"_n{i}")).alias("_col"))
    posts = [post(i, j) if j == 0 else F.when(F.col(f"_n{i}") > (1 if j == 1 else 2), post(i, j)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return at.withColumn("_post", F.explode(F.array(*posts))).filter("_post is not null").select(*df.columns, "_post._row", "_post._col")


def packed(df: DataFrame, keys: list[str], out: str, most: int = 1000) -> DataFrame:
    """keys, `_part2`, the rows of df of equal keys as an array, and _n, how many there are; a key of more than `most` rows has an array
    for about every `most` of them, told apart by _part2. Rows with a null among keys are left out."""
    known = df.dropna(subset=keys)
    hot = known.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias("_parts")).filter("_parts > 1")
    part = F.pmod(F.xxhash64(*df.columns), F.coalesce("_parts", F.lit(1).cast("long"))).alias("_part2")
    cut = known.join(F.broadcast(hot), keys, "left").select(*keys, part, F.struct(*df.columns).alias("_row"))
    return cut.groupBy(*keys, "_part2").agg(F.collect_list("_row").alias(out), F.count("*").alias("_n"))


def radius_pairs(left: DataFrame, right: DataFrame, radius_m: float, condition: Column | None = None) -> DataFrame:
    """Pairs of (lat, lon) and (lat2, lon2) at most radius_m apart, with distance_m: right rows are posted in
    their grid cell and its neighbours. Rows of one place travel together, so that a distance is told once for all of them,
    and pairs are made last, where they are, without a shuffle of theirs."""
    a, b = packed(left, ["lat", "lon"], "_rows").drop("_part2"), packed(right, ["lat2", "lon2"], "_rows2")
    met = salted_join(cell_of(a, "lat", "lon", radius_m), cells_near(b, "lat2", "lon2", radius_m), ["_row", "_col"], ["lat2", "lon2", "_part2"], 5_000_000, F.col("_n"))
    near = met.withColumn("distance_m", haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).filter(F.col("distance_m") <= radius_m)
    near = near.select("distance_m", "_rows2", F.explode("_rows").alias("_l")).select("distance_m", "_l", F.explode("_rows2").alias("_r")).select("_l.*", "_r.*", "distance_m")
    return near if condition is None else near.filter(condition)


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, out: str = "median") -> DataFrame:
    """Per key the least value at which the running weight reaches half of the total.

    Equal values are summed first, before the shuffle, so that a hot key brings one row per value, and these are cut
    into chunks (running_totals)."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    both = running_totals(sums, keys, [value], {"_run": "_w"}, whole=True)
    return both.filter(2 * F.col("_run") >= F.col("_run_all")).groupBy(*keys).agg(F.min(value).alias(out))


def quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Linearly interpolated quartiles and median per key; null where a key has no values.

    Equal values are counted first, and the counts run along the values in chunks (running_totals), so that no task
    holds all values of a hot key."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    run = running_totals(counts, keys, [value], {"_run": "_n"}, whole=True)
    place = {q: (F.col("_run_all") - 1) * F.lit(q) for q in (0.25, 0.5, 0.75)}
    at = lambda where: F.min(F.when(F.col("_run") > where, F.col(value)))
    ends = run.groupBy(*keys, "_run_all").agg(*(at(f(p)).cast("double").alias(f"_{n}{q}") for q, p in place.items() for n, f in (("lo", F.floor), ("hi", F.ceil))))
    lo, hi = (lambda q: F.col(f"`_lo{q}`")), (lambda q: F.col(f"`_hi{q}`"))
    between = lambda q, p: F.when(lo(q) == hi(q), lo(q)).otherwise((F.ceil(p) - p) * lo(q) + (p - F.floor(p)) * hi(q))
    found = ends.select(*keys, *(between(q, p).alias(f"q{round(100 * q)}") for q, p in place.items()))
    return same_keys(df.select(*keys).distinct(), found, keys)


def iqr_marked(df: DataFrame, keys: list[str], value: str, least_rows: int = 5, reach: float = 1.5) -> DataFrame:
    """Rows with `outlier`: strictly beyond `reach` interquartile ranges, in groups of enough rows whose
    range is above zero."""
    stats = quartiles(df, keys, value).join(df.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    iqr = F.col("q75") - F.col("q25")
    beyond = (F.col(value) < F.col("q25") - reach * iqr) | (F.col(value) > F.col("q75") + reach * iqr)
    return df.join(stats, keys).withColumn("outlier", (F.col("_n") >= least_rows) & (iqr > 0) & beyond).drop("_n", "q50")


def islands(df: DataFrame, keys: list[str], order: list[str], flag: Column, run: str = "run") -> DataFrame:
    """The length of the current run of rows with flag, 0 where it is false."""
    w = Window.partitionBy(*keys).orderBy(*order)
    breaks = F.sum(F.when(flag, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("_flag", flag).withColumn("_island", breaks)
    inside = Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(run, F.sum(F.when(F.col("_flag"), 1).otherwise(0)).over(inside)).drop("_flag", "_island")
