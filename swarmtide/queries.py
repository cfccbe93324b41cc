"""Registered queries of the particle operators over the stand-in views, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swarmtide.functions import cosmology, numbers
from swarmtide.functions import geometry as geo
from swarmtide.operators import aggregates, branches, lookups, membership, neighbours, nests, statistics, unbinding
from swarmtide.plans import views
from swarmtide.plans.ordering import numbered
from swarmtide.plans.views import SQL, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BOX = 1.0
HUBBLE, SCALE, G = 0.1, 0.5, 43.0071
V = aggregates.VELOCITIES


def query(sql: str):
    """Registers a query under its function's name. ``{pts}`` and so on stand for the views."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql.format(**{k: f"({v}) AS {k}" for k, v in SQL.items()})
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating results to a fixed number of places, zero without a sign."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def r(sql: str, digits: int = 6) -> str:
    return f"round({sql}, {digits}) + 0.0"


NEAR = "(CASE WHEN {d} > 0.5 THEN {d} - 1 WHEN {d} < -0.5 THEN {d} + 1 ELSE {d} END)"
near = lambda d: NEAR.format(d=f"({d})")
FIRST = "(SELECT halo_id, arg_min(x, id) AS ox, arg_min(y, id) AS oy, arg_min(z, id) AS oz, arg_min(vx, id) AS ovx, arg_min(vy, id) AS ovy, arg_min(vz, id) AS ovz FROM {pts} GROUP BY halo_id)"
D = {c: near(f"p.{c} - o.o{c}") for c in "xyz"}
R2 = f"({D['x']} * {D['x']} + {D['y']} * {D['y']} + {D['z']} * {D['z']})"
MEANS = ", ".join(f"sum(p.mass * {D[c]}) / sum(p.mass) + any_value(o.o{c}) AS {c}" for c in "xyz")
SEEN = f"(SELECT * FROM {{pts}}) p JOIN {FIRST} o USING (halo_id)"
PROFILE = f"""(SELECT halo_id, id, greatest(r0, 0.01) AS r, sum(mass) OVER w AS m, row_number() OVER w AS k, count(*) OVER (PARTITION BY halo_id) AS n
    FROM (SELECT p.*, sqrt{R2} AS r0 FROM {SEEN}) WINDOW w AS (PARTITION BY halo_id ORDER BY r0, id))"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pts(spark, sf_dir)


@query(f"""WITH m AS (SELECT halo_id, sum(p.mass) AS halo_mass, {MEANS} FROM {SEEN} GROUP BY halo_id),
    v AS (SELECT halo_id, {", ".join(f"sum(mass * {c}) / sum(mass) AS {c}" for c in V)} FROM {{pts}} GROUP BY halo_id),
    q AS (SELECT id, halo_id, row_number() OVER (PARTITION BY halo_id ORDER BY mass * (1 + id % 7) DESC, id) - 1 AS place FROM {{pts}})
    SELECT id, halo_id, CASE WHEN halo_id = -1 THEN 0 ELSE place END AS rank, halo_mass, {", ".join(f"{r(f'm.{c}')} AS {c}" for c in "xyz")},
    {", ".join(f"{r(f'v.{c}')} AS {c}" for c in V)} FROM q JOIN m USING (halo_id) JOIN v USING (halo_id)""")
def member_rank(spark, sf_dir):
    p = _groups(spark, sf_dir)
    ranked = membership.member_rank(p.withColumn("w", F.col("mass") * (1 + F.col("id") % 7)), "halo_id", "w", "id").select("id", "halo_id", "rank")
    means = aggregates.mean_position(p, "halo_id", "id", BOX).withColumnRenamed("mass", "halo_mass")
    return rounded(ranked.join(means, "halo_id").join(aggregates.mean_velocity(p, "halo_id").drop("mass"), "halo_id"))


@query(f"SELECT halo_id, sum(p.mass) AS mass, {', '.join(f'round(sum(p.mass * {D[c]}) / sum(p.mass) + any_value(o.o{c}), 6) + 0.0 AS {c}' for c in 'xyz')} FROM {SEEN} GROUP BY halo_id")
def halo_mean_position(spark, sf_dir):
    return rounded(aggregates.mean_position(_groups(spark, sf_dir), "halo_id", "id", BOX))


@query(f"SELECT halo_id, sum(mass) AS mass, {', '.join(f'round(sum(mass * {c}) / sum(mass), 6) + 0.0 AS {c}' for c in V)} FROM {{pts}} GROUP BY halo_id")
def halo_mean_velocity(spark, sf_dir):
    return rounded(aggregates.mean_velocity(_groups(spark, sf_dir), "halo_id"))


@query(f"SELECT track, {', '.join(f'count(*) FILTER (type = {t}) AS n{t}, coalesce(sum(mass) FILTER (type = {t}), 0.0) AS m{t}' for t in range(6))} FROM {{cat}} GROUP BY track")
def typed_counts(spark, sf_dir):
    found = aggregates.typed_counts(views.cat(spark, sf_dir), "track")
    return found.select("track", *(F.col(f"{k}bound_type")[t].alias(f"{k}{t}") for t in range(6) for k in "nm"))


@query("SELECT count(*) AS n_particles, count(DISTINCT track) AS n_tracks, max(n) AS largest FROM (SELECT track, count(*) OVER (PARTITION BY track) AS n FROM {cat})")
def total_stats(spark, sf_dir):
    sizes = views.cat(spark, sf_dir).groupBy("track").count()
    return sizes.agg(F.sum("count").alias("n_particles"), F.count("*").alias("n_tracks"), F.max("count").alias("largest"))


@query("SELECT c_custkey AS halo_id FROM customer WHERE c_custkey NOT IN (SELECT host FROM {tracks})")
def empty_groups(spark, sf_dir):
    halos = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("halo_id"))
    return membership.births(halos, views.tracks(spark, sf_dir), "host")


@query("""SELECT l.id, coalesce(min(CASE WHEN l.id >= 0 THEN p.p_size END), -1)::BIGINT AS size FROM (SELECT DISTINCT l_partkey - 5 AS id FROM lineitem) l
    LEFT JOIN part p ON p.p_partkey = l.id GROUP BY l.id""")
def id_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") - 5).alias("id")).distinct()
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return lookups.lookup(ids, parts, "id", "p_size", "size").select("id", "size")


@query("SELECT track, ord, id & 255 AS id FROM {cat}")
def id_mask(spark, sf_dir):
    return views.cat(spark, sf_dir).select("track", "ord", F.col("id").bitwiseAND(255).alias("id"))


@query("""SELECT i.id, coalesce(h.halo_id, CASE WHEN s.id IS NOT NULL THEN -1 ELSE -2 END)::BIGINT AS host_halo_id FROM (SELECT DISTINCT o_custkey - 20 AS id FROM orders) i
    LEFT JOIN (SELECT id, min(halo_id) AS halo_id FROM {pts} WHERE halo_id >= 0 GROUP BY id) h USING (id) LEFT JOIN (SELECT DISTINCT id FROM {pts}) s USING (id)""")
def host_two_level(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select((F.col("o_custkey") - 20).alias("id")).distinct()
    p = views.pts(spark, sf_dir)
    return lookups.two_level_host(ids, p.where("halo_id >= 0"), p)


@query("""SELECT track, coalesce(halo_id, -1)::BIGINT AS host_halo_id FROM (SELECT track, id FROM {cat} WHERE ord = 0)
    LEFT JOIN (SELECT id, min(halo_id) AS halo_id FROM {pts} WHERE halo_id >= 0 GROUP BY id) USING (id)""")
def host_of_tracer(spark, sf_dir):
    return lookups.tracer_hosts(views.cat(spark, sf_dir), views.pts(spark, sf_dir).where("halo_id >= 0"))


@query("""SELECT track, row_number() OVER (PARTITION BY track ORDER BY ord) - 1 AS ord, id, nbound FROM
    (SELECT *, (count(*) FILTER (id % 3 != 0 AND ord < 3) OVER (PARTITION BY track))::BIGINT AS nbound FROM {cat}) WHERE id % 3 != 0""")
def kick_missing(spark, sf_dir):
    lists = views.cat(spark, sf_dir).select("track", "ord", "id", F.lit(3).alias("nbound"))
    present = table(spark, sf_dir, "part").where("p_partkey % 3 != 0").select(F.col("p_partkey").alias("id"), F.lit(True).alias("found"))
    seen = lookups.refresh(lists, present, ["id"]).withColumn("found", F.coalesce("found", F.lit(False)))
    return lookups.kick_missing(seen, "track", "nbound").select("track", "ord", "id", "nbound")


@query("SELECT o_orderkey AS track, coalesce(any_value(id), -1)::BIGINT AS most_bound_id FROM orders LEFT JOIN (SELECT * FROM {cat} WHERE ord = 0) ON track = o_orderkey GROUP BY o_orderkey")
def most_bound_id(spark, sf_dir):
    every = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("track"))
    return lookups.most_bound(every.join(views.cat(spark, sf_dir), "track", "left"), "track")


@query("SELECT track, n, (sum(n) OVER (ORDER BY track) - n)::BIGINT AS first FROM (SELECT track, count(*) AS n FROM {cat} GROUP BY track)")
def offsets_prefix_sum(spark, sf_dir):
    """Exclusive prefix sums over a global order: range partitions first, so that no task holds all."""
    sizes = views.cat(spark, sf_dir).groupBy("track").agg(F.count("*").alias("n"))
    spread = numbered(sizes, ["track"], "k").withColumn("b", F.floor((F.col("k") - 1) / 4096))
    blocks = spread.groupBy("b").agg(F.sum("n").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spread.withColumn("i", inside).join(blocks.select("b", before.alias("o")), "b").select("track", "n", (F.col("o") + F.col("i")).alias("first"))


@query("SELECT c_custkey AS id, ntile(7) OVER (ORDER BY c_custkey) - 1 AS task FROM customer")
def task_ranges(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return numbered(ids, ["id"], "k", 0).select("id", lookups.task_range(F.col("k"), ids.count(), 7).alias("task"))


@query("SELECT track, ord, id FROM (SELECT *, track % 4 AS nbound FROM {cat}) WHERE ord < CASE WHEN nbound <= 1 THEN nbound ELSE floor(nbound * 1.5) END")
def truncate_source(spark, sf_dir):
    lists = views.cat(spark, sf_dir).withColumn("nbound", F.col("track") % 4)
    return lookups.truncate_source(lists, "track", 1.5).select("track", "ord", "id")


@query("SELECT id, mass, row_number() OVER (ORDER BY mass DESC, id) - 1 AS place FROM {pts}")
def global_id_order(spark, sf_dir):
    return numbered(views.pts(spark, sf_dir).select("id", "mass"), [F.desc("mass"), F.col("id")], "place")


@query("SELECT snapshot, halo, mass, 1.0::DOUBLE / (1 + (29 - snapshot)) AS scale_factor, mass - lag(mass) OVER (ORDER BY snapshot) AS gain FROM {steps} WHERE id = 7")
def track_series(spark, sf_dir):
    series = views.steps(spark, sf_dir).where("id = 7")
    gain = F.col("mass") - F.lag("mass").over(Window.partitionBy("id").orderBy("snapshot"))
    return series.select("snapshot", "halo", "mass", (1.0 / (1 + (29 - F.col("snapshot")))).alias("scale_factor"), gain.alias("gain"))


@query("SELECT id AS track, min(snapshot) AS birth, max(snapshot) AS last, count(*) AS n FROM {steps} GROUP BY id")
def track_birth(spark, sf_dir):
    return views.steps(spark, sf_dir).groupBy(F.col("id").alias("track")).agg(F.min("snapshot").alias("birth"), F.max("snapshot").alias("last"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT *, count(*) OVER (PARTITION BY track) AS n FROM {cat})
    SELECT track, ord, id FROM (SELECT * FROM s WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY n, track, ord) = 1) UNION ALL SELECT track, ord, id FROM s WHERE n <= 1""")
def exclusive_particles(spark, sf_dir):
    return lookups.exclusive(views.cat(spark, sf_dir).select("track", "ord", "id"), "track")


@query("""SELECT track, mass, row_number() OVER (ORDER BY track) - 1 AS place FROM (SELECT * FROM {tracks}) WHERE snapshot % 2 = 0 OR snapshot % 2 = 1""")
def merge_catalogues(spark, sf_dir):
    t = views.tracks(spark, sf_dir).select("track", "mass", "snapshot")
    files = t.where("snapshot % 2 = 0").unionByName(t.where("snapshot % 2 = 1"))
    return numbered(files.select("track", "mass"), ["track"], "place")


@query("""SELECT redshift, name FROM (SELECT round((o_orderkey % 97) / 10.0, 1)::DOUBLE AS redshift, 'snap_' || lpad(o_orderkey::VARCHAR, 9, '0') AS name FROM orders)
    QUALIFY row_number() OVER (PARTITION BY redshift ORDER BY name) = 1""")
def snapshot_dedupe(spark, sf_dir):
    """Of names of snapshots with one redshift the first stays; the redshift is read from the name."""
    part = F.format_string("%03d", F.floor(F.col("k") % 97 / 10)), F.format_string("%d", F.col("k") % 97 % 10)
    names = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    named = names.select(F.concat(F.lit("snap_"), F.lpad(F.col("k").cast("string"), 9, "0"), F.lit("_z"), part[0], F.lit("p"), part[1]).alias("f"))
    z = F.regexp_replace(F.regexp_extract("f", r"_z(\d+p\d+)$", 1), "p", ".").cast("double")
    return named.groupBy(z.alias("redshift")).agg(F.min(F.regexp_extract("f", r"^(.*)_z", 1)).alias("name"))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY mass DESC, track) - 1 AS rank, max(mass) OVER (PARTITION BY host) AS top FROM {tracks} WHERE host >= 0),
    w AS (SELECT host, arg_min(rank, kdist * 1000000 + rank) AS win FROM a WHERE mass >= 0.8 * top GROUP BY host)
    SELECT track, host, CASE WHEN rank = win THEN 0 WHEN rank = 0 THEN win ELSE rank END AS place FROM a JOIN w USING (host)""")
def decide_central(spark, sf_dir):
    ranked = membership.member_rank(views.tracks(spark, sf_dir).where("host >= 0"), "host", "mass", "track")
    return membership.decide_central(ranked, "host").select("track", "host", "place")


@query("SELECT c_custkey AS halo_id, c_acctbal AS mass FROM customer WHERE c_custkey NOT IN (SELECT host FROM {tracks})")
def births(spark, sf_dir):
    halos = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("halo_id"), F.col("c_acctbal").alias("mass"))
    return membership.births(halos, views.tracks(spark, sf_dir), "host")


@query("SELECT halo_id, 1000000 + row_number() OVER (ORDER BY halo_id) - 1 AS track_id FROM (SELECT c_custkey AS halo_id FROM customer WHERE c_custkey % 5 > 1)")
def track_ids(spark, sf_dir):
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("halo_id"), (F.col("c_custkey") % 5).alias("nbound"))
    return membership.track_ids(new, 1_000_000).select("halo_id", "track_id")


@query("SELECT id, snapshot, max(mass) OVER w AS last_max, arg_max(snapshot, (mass, snapshot)) OVER w AS at_last_max FROM {steps} WINDOW w AS (PARTITION BY id ORDER BY snapshot)")
def running_max_mass(spark, sf_dir):
    return membership.running_max(views.steps(spark, sf_dir), "id", "snapshot", "mass").select("id", "snapshot", "last_max", "at_last_max")


@query("SELECT id, snapshot, coalesce(max(CASE WHEN halo = 'click' THEN snapshot END) OVER (PARTITION BY id ORDER BY snapshot), -1)::BIGINT AS last_isolation FROM {steps}")
def last_isolation(spark, sf_dir):
    t = views.steps(spark, sf_dir).withColumn("rank", F.when(F.col("halo") == "click", 0).otherwise(1))
    return membership.last_isolation(t, "id", "snapshot", "rank").select("id", "snapshot", "last_isolation")


@query("""SELECT host, track, ord, id FROM (SELECT * FROM {cat}) WHERE track % 9 != 0 QUALIFY row_number() OVER (PARTITION BY host, id ORDER BY -track, ord) = 1
    UNION ALL SELECT host, track, ord, id FROM {cat} WHERE track % 9 = 0""")
def priority_mask(spark, sf_dir):
    lists = views.cat(spark, sf_dir).withColumn("visit", -F.col("track"))
    return membership.priority_mask(lists, "host", "visit", F.col("track") % 9 == 0).select("host", "track", "ord", "id")


@query("""WITH s AS (SELECT *, count(*) OVER (PARTITION BY host, track) AS n FROM {cat}), f AS (SELECT *, min(n * 100000000 + track) OVER (PARTITION BY host, id) = n * 100000000 + track AS mine FROM s)
    SELECT host, track, arg_min(id, ord * 100000000 + id) FILTER (mine) AS most_bound_id FROM f GROUP BY host, track""")
def purge_most_bound(spark, sf_dir):
    return membership.purge_most_bound(views.cat(spark, sf_dir), "host", "track")


@query("""SELECT host, row_number() OVER (PARTITION BY host ORDER BY track, ord, id) - 1 AS ord, id FROM
    (SELECT * FROM {cat} QUALIFY row_number() OVER (PARTITION BY host, id ORDER BY track, ord) = 1)""")
def merge_union(spark, sf_dir):
    lists = views.cat(spark, sf_dir).select("host", F.col("track").alias("prio"), "ord", "id")
    return membership.merge_union(lists, "host").select("host", "ord", "id")


CHAIN = "RECURSIVE c AS (SELECT child, parent AS ancestor, 1::BIGINT AS level FROM {tree} UNION ALL SELECT c.child, t.parent, c.level + 1 FROM c JOIN {tree} t ON t.child = c.ancestor)".replace("{tree} t", "(SELECT * FROM {tree}) t")


@query(f"WITH {CHAIN} SELECT * FROM c")
def ancestor_chain(spark, sf_dir):
    return nests.ancestors(views.tree(spark, sf_dir))


@query(f"WITH {CHAIN} SELECT t.child AS track, coalesce(max(level), 0)::BIGINT AS depth FROM (SELECT child FROM {{tree}} UNION SELECT 0) t LEFT JOIN c USING (child) GROUP BY t.child")
def nest_depth(spark, sf_dir):
    links = views.tree(spark, sf_dir)
    return nests.depth(links.select(F.col("child").alias("track")).union(links.select("parent").where("parent = 0")).distinct(), links)


@query(f"WITH {CHAIN} SELECT child, arg_min(ancestor, level) AS sink FROM c WHERE ((child * 31 + ancestor * 17) % 100) / 25.0 < 2 GROUP BY child")
def sink_detect(spark, sf_dir):
    chain = nests.ancestors(views.tree(spark, sf_dir))
    near_ = chain.select("child", "ancestor", ((F.col("child") * 31 + F.col("ancestor") * 17) % 100 / 25.0).alias("distance"))
    return nests.sinks(chain, near_)


@query("""SELECT a.child, a.parent, (a.child % 3 != a.parent % 3 OR a.child % 11 = 0) AS detached FROM (SELECT * FROM {tree}) a WHERE a.parent > 0""")
def level_up_detached(spark, sf_dir):
    links = views.tree(spark, sf_dir).select("child", "parent")
    tracks = links.select(F.col("child").alias("track"), (F.col("child") % 3).alias("host"), (F.col("child") % 11 == 0).alias("head"))
    return nests.detached(links, tracks)


@query("""WITH h AS (SELECT host, track, row_number() OVER (PARTITION BY host ORDER BY mass DESC, track) - 1 AS place FROM {tracks} WHERE host >= 0),
    n AS (SELECT track AS child, track + 1 AS parent FROM {tracks} WHERE track % 3 = 0)
    SELECT child, parent FROM n WHERE child NOT IN (SELECT track FROM h WHERE place = 0)
    UNION ALL SELECT a.track, b.track FROM h a JOIN h b ON a.host = b.host AND b.place = 0 WHERE a.place > 0""")
def extend_central_nest(spark, sf_dir):
    t = views.tracks(spark, sf_dir)
    heads = membership.member_rank(t.where("host >= 0"), "host", "mass", "track").withColumnRenamed("rank", "place")
    links = t.where("track % 3 = 0").select(F.col("track").alias("child"), (F.col("track") + 1).alias("parent"))
    return nests.extend_central(links, heads)


@query("SELECT c_custkey AS id, round(c_acctbal - floor(c_acctbal / 1000) * 1000, 6) + 0.0 AS x FROM customer")
def wrap_position(spark, sf_dir):
    return rounded(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), geo.wrap(F.col("c_acctbal"), 1000.0).alias("x")))


@query(f"SELECT p.id, round(sqrt{R2}, 6) + 0.0 AS d FROM {SEEN}")
def min_image_distance(spark, sf_dir):
    seen = aggregates.with_origin(_groups(spark, sf_dir), "halo_id", "id")
    at = tuple(F.col(c) for c in "xyz"), tuple(F.col(f"__o.{c}") for c in "xyz")
    return rounded(seen.select("id", geo.distance(*at, BOX).alias("d")))


@query("SELECT id, (floor(x * 8) + floor(y * 8) * 8 + floor(z * 8) * 64)::BIGINT AS cell, least(greatest(floor(vx * 8), 0), 7)::BIGINT AS vcell FROM {pts}")
def grid_cell(spark, sf_dir):
    g = [geo.cell(F.col(c), 0.125, 8, True) for c in "xyz"]
    return views.pts(spark, sf_dir).select("id", geo.cell_index(*g, 8).alias("cell"), geo.cell(F.col("vx"), 0.125, 8, False).alias("vcell"))


@query(f"SELECT p.id, {', '.join(f'round(p.v{c} - o.ov{c} + 0.05 * {D[c]}, 6) + 0.0 AS v{c}' for c in 'xyz')} FROM {SEEN}")
def relative_velocity(spark, sf_dir):
    seen = aggregates.with_origin(_groups(spark, sf_dir), "halo_id", "id", (*"xyz", *V))
    v, v0 = [F.col(c) for c in V], [F.col(f"__o.{c}") for c in V]
    x, x0 = [F.col(c) for c in "xyz"], [F.col(f"__o.{c}") for c in "xyz"]
    out = geo.relative_velocity(v, v0, x, x0, HUBBLE, SCALE, BOX)
    return rounded(seen.select("id", *(c.alias(n) for c, n in zip(out, V))))


PAIR = "(SELECT c.id AS c_id, p.id, " + ", ".join(f"{near(f'p.{c} - c.{c}')} AS d{c}" for c in "xyz") + " FROM (SELECT * FROM {pts}) p, (SELECT * FROM {pts}) c)"
D2 = "(dx * dx + dy * dy + dz * dz)"


@query(f"SELECT c_id, id, {r(D2, 9)} AS d2 FROM {PAIR} WHERE {D2} < 0.0144")
def radius_search(spark, sf_dir):
    p = views.pts(spark, sf_dir)
    return rounded(neighbours.within(p, p, 0.12, BOX), 9)


@query(f"SELECT c_id, id, {r(D2, 9)} AS d2 FROM {PAIR} WHERE {D2} < 0.0144 AND {D2} > 0.0064")
def shell_search(spark, sf_dir):
    p = views.pts(spark, sf_dir)
    return rounded(neighbours.shell(p, p, 0.08, 0.12, BOX), 9)


@query(f"SELECT c_id, id, {r('(dx * dx + dy * dy)', 9)} AS d2 FROM {PAIR} WHERE abs(dz) <= 0.2 AND dx * dx + dy * dy < 0.0025")
def cylinder_search(spark, sf_dir):
    p = views.pts(spark, sf_dir)
    return rounded(neighbours.cylinder(p, p, 0.2, 0.05, BOX), 9)


@query(f"SELECT c_id, id, {r(D2, 9)} AS d2, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_id ORDER BY {D2}, id) AS rank FROM {PAIR}) WHERE rank <= 4")
def nearest_neighbour(spark, sf_dir):
    p = views.pts(spark, sf_dir)
    return rounded(neighbours.nearest(p, p, 4, 0.1, BOX), 9)


@query(f"""WITH n AS (SELECT c_id, sqrt{D2} AS r FROM (SELECT *, row_number() OVER (PARTITION BY c_id ORDER BY {D2}, id) AS k FROM {PAIR}) WHERE k <= 16),
    h AS (SELECT *, max(r) OVER (PARTITION BY c_id) AS h FROM n)
    SELECT c_id, round(sum(CASE WHEN r / h < 0.5 THEN 8 / pi() * (1 + 6 * (r / h - 1) * (r / h) * (r / h)) ELSE 16 / pi() * (1 - r / h) ** 3 END / h ** 3), 3) + 0.0 AS density FROM h GROUP BY c_id""")
def sph_density(spark, sf_dir):
    p = views.pts(spark, sf_dir)
    return rounded(neighbours.sph_density(p, p, 16, 0.2, BOX), 3)


FOF = f"RECURSIVE e AS (SELECT c_id AS a, id AS b FROM {PAIR} WHERE {D2} < 0.0049), g AS (SELECT id, id AS root FROM {{pts}} UNION SELECT e.a, g.root FROM g JOIN e ON g.id = e.b)"


@query(f'WITH {FOF} SELECT id, min(root) AS "group" FROM g GROUP BY id')
def fof_groups(spark, sf_dir):
    return neighbours.friends_of_friends(views.pts(spark, sf_dir), 0.07, BOX)


@query(f"WITH {FOF} SELECT grp, count(*) AS n FROM (SELECT id, min(root) AS grp FROM g GROUP BY id) GROUP BY grp")
def fof_sizes(spark, sf_dir):
    found = neighbours.friends_of_friends(views.pts(spark, sf_dir), 0.07, BOX)
    return found.groupBy(F.col("group").alias("grp")).agg(F.count("*").alias("n"))


@query("SELECT min(c_custkey) AS low, max(c_custkey) AS high, count(*) AS n, max(c_custkey) - min(c_custkey) + 1 = count(*) AS contiguous FROM customer")
def contiguity_check(spark, sf_dir):
    found = table(spark, sf_dir, "customer").agg(F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"), F.count("*").alias("n"))
    return found.withColumn("contiguous", F.col("high") - F.col("low") + 1 == F.col("n"))


@query(f"SELECT halo_id, id, round(r, 6) + 0.0 AS r, m, k FROM {PROFILE}")
def mass_profile(spark, sf_dir):
    return rounded(aggregates.profile(_groups(spark, sf_dir), "halo_id", "id", BOX, 0.01).select("halo_id", "id", "r", "m", "k"))


@query(f"SELECT halo_id, round(CASE WHEN max(n) <= 1 THEN 0 ELSE arg_max(r, (m / r, -k)) END, 6) + 0.0 AS rmax, round(CASE WHEN max(n) <= 1 THEN 0 ELSE sqrt(max(m / r) * {G} / 0.5) END, 6) + 0.0 AS vmax FROM {PROFILE} GROUP BY halo_id")
def vmax_rmax(spark, sf_dir):
    prof = aggregates.profile(_groups(spark, sf_dir), "halo_id", "id", BOX, 0.01)
    return rounded(aggregates.vmax_rmax(prof, "halo_id", G, SCALE))


@query(f"""SELECT halo_id, round(max(CASE WHEN k - 1 = floor(n * 0.5) THEN r END), 6) + 0.0 AS rhalf, round(max(CASE WHEN k - 1 = floor(n * 0.955) THEN r END), 6) + 0.0 AS r2sigma
    FROM {PROFILE} WHERE n > 1 GROUP BY halo_id UNION ALL SELECT halo_id, 0.0, 0.0 FROM {PROFILE} WHERE n <= 1""")
def half_mass_radius(spark, sf_dir):
    prof = aggregates.profile(_groups(spark, sf_dir), "halo_id", "id", BOX, 0.01)
    half = aggregates.radius_of_share(prof, "halo_id", 0.5, "rhalf")
    return rounded(half.join(aggregates.radius_of_share(prof, "halo_id", 0.955, "r2sigma"), "halo_id"))


@query(f"SELECT halo_id, coalesce(arg_max(m, k) FILTER (m > 5000 * r ** 3), 0.0) AS mass_in, round((coalesce(arg_max(m, k) FILTER (m > 5000 * r ** 3), 0.0) / 5000) ** (1 / 3.0::DOUBLE), 6) + 0.0 AS radius_in FROM {PROFILE} GROUP BY halo_id")
def spherical_overdensity(spark, sf_dir):
    prof = aggregates.profile(_groups(spark, sf_dir), "halo_id", "id", BOX, 0.01)
    return rounded(aggregates.overdensity(prof, "halo_id", 5000.0))


CORE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY halo_id ORDER BY id) - 1 AS ord FROM {pts}) WHERE ord < 20)"


def _variance(c: str, d: str) -> str:
    return f"sum(p.mass * {d} * {d}) / sum(p.mass) - (sum(p.mass * {d}) / sum(p.mass)) ** 2"


@query(f"""SELECT halo_id, round(CASE WHEN count(*) <= 1 THEN 0 ELSE sqrt({' + '.join(_variance(c, D[c]) for c in 'xyz')}) END, 6) + 0.0 AS sigma_r,
    round(CASE WHEN count(*) <= 1 THEN 0 ELSE sqrt({' + '.join(_variance(c, f'(p.v{c} - o.ov{c})') for c in 'xyz')}) END, 6) + 0.0 AS sigma_v FROM {CORE} p JOIN {FIRST} o USING (halo_id) GROUP BY halo_id""")
def core_dispersion(spark, sf_dir):
    w = Window.partitionBy("halo_id").orderBy("id")
    p = _groups(spark, sf_dir).withColumn("ord", F.row_number().over(w) - 1)
    places = aggregates.core_dispersion(p, "halo_id", ("x", "y", "z"), BOX).withColumnRenamed("sigma", "sigma_r")
    return rounded(places.join(aggregates.core_dispersion(p, "halo_id", V, None).withColumnRenamed("sigma", "sigma_v"), "halo_id"))


PLAIN = ", ".join(f"round(sum(p.mass * {D[a]} * {D[b]}) / sum(p.mass), 6) + 0.0 AS i{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
WEIGHTED = ", ".join(f"round(coalesce(sum(p.mass * {D[a]} * {D[b]} / {R2}) FILTER ({R2} > 0), 0) / sum(p.mass), 6) + 0.0 AS w{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))


@query(f"SELECT halo_id, {PLAIN}, {WEIGHTED} FROM {SEEN} GROUP BY halo_id")
def inertia_tensor(spark, sf_dir):
    return rounded(aggregates.inertia(_groups(spark, sf_dir), "halo_id", "id", BOX))


KD = {c: f"({D[c]} * 0.5)" for c in "xyz"}
KV = {c: f"(p.v{c} - o.ov{c} + 0.1 * {KD[c]})" for c in "xyz"}


@query(f"""SELECT halo_id, round(sum(p.mass * ({' + '.join(f'{KV[c]} * {KV[c]}' for c in 'xyz')})) / 2 / sum(p.mass), 6) + 0.0 AS kinetic,
    {', '.join(f'round(sum(p.mass * ({KD[b]} * {KV[c]} - {KD[c]} * {KV[b]})) / sum(p.mass), 6) + 0.0 AS l{a}' for a, b, c in ('xyz', 'yzx', 'zxy'))} FROM {SEEN} GROUP BY halo_id HAVING count(*) > 1""")
def kinematics(spark, sf_dir):
    p = _groups(spark, sf_dir)
    first = p.groupBy("halo_id").agg(F.min_by(F.struct(*"xyz", *V), "id").alias("o"))
    frame = first.select("halo_id", *(F.col(f"o.{c}").alias(f"{c}0") for c in (*"xyz", *V)))
    return rounded(aggregates.kinematics(p, "halo_id", frame, HUBBLE, SCALE, BOX))


def _percentiles(groups: str, where: str = "TRUE") -> str:
    cols = ", ".join(
        f"round(coalesce(arg_min(CASE WHEN p0 IS NULL THEN y ELSE y0 + (y - y0) * ({q} - p0) / (p - p0) END, p) FILTER (p >= {q}), max(y)), 6) + 0.0 AS p{q}" for q in (16, 50, 84)
    )
    return f"""WITH a AS (SELECT *, sum(w) OVER (PARTITION BY {groups} ORDER BY y, tie ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY {groups}) * 100 AS p FROM s WHERE {where}),
        b AS (SELECT *, lag(p) OVER (PARTITION BY {groups} ORDER BY y, tie) AS p0, lag(y) OVER (PARTITION BY {groups} ORDER BY y, tie) AS y0 FROM a)
        SELECT {groups}, {cols} FROM b GROUP BY {groups}"""


@query(_percentiles("g").replace("FROM s", "FROM (SELECT o_custkey % 10 AS g, o_totalprice AS y, (o_orderkey % 5 + 1)::DOUBLE AS w, o_orderkey AS tie FROM orders)"))
def weighted_percentile(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = o.select((F.col("o_custkey") % 10).alias("g"), F.col("o_totalprice").alias("y"), (F.col("o_orderkey") % 5 + 1).cast("double").alias("w"), F.col("o_orderkey").alias("tie"))
    return rounded(statistics.weighted_percentiles(s, ["g"], "y", "w", [16.0, 50.0, 84.0]))


EDGES = [0.0, 50.0, 100.0, 200.0, 400.0]
BINS = "CASE " + " ".join(f"WHEN {{x}} >= {a} AND {{x}} < {b} THEN {i}" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:]))) + " END"


@query(_percentiles("bin", "bin IS NOT NULL").replace("FROM s", f"FROM (SELECT ({BINS.replace('{x}', 'value')})::BIGINT AS bin, (user_id % 11)::DOUBLE AS y, (event_id % 4 + 1)::DOUBLE AS w, event_id AS tie FROM events)"))
def weighted_crosssection(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.select(statistics.bin_of(F.col("value"), EDGES).alias("bin"), (F.col("user_id") % 11).cast("double").alias("y"), (F.col("event_id") % 4 + 1).cast("double").alias("w"), F.col("event_id").alias("tie"))
    return rounded(statistics.weighted_percentiles(s.where("bin is not null"), ["bin"], "y", "w", [16.0, 50.0, 84.0]))


@query(f"""WITH b AS (SELECT ({BINS.replace('{x}', 'value')})::BIGINT AS bin, (user_id % 3 + 1)::DOUBLE AS w FROM events)
    SELECT bin, count(*) AS n, sum(w) AS w, round(sum(w) / sum(sum(w)) OVER () / [{', '.join(str(b - a) for a, b in zip(EDGES, EDGES[1:]))}][bin + 1]::DOUBLE, 9) + 0.0 AS density FROM b WHERE bin IS NOT NULL GROUP BY bin""")
def histogram(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("wt", (F.col("user_id") % 3 + 1).cast("double"))
    return rounded(statistics.histogram(e, "value", EDGES, "wt"), 9)


@query(f"""SELECT bin, count(*) AS n, round(avg(y), 6) + 0.0 AS mean, round(quantile_cont(y, 0.5), 6) + 0.0 AS median, round(stddev_pop(y), 6) + 0.0 AS std,
    round(quantile_cont(y, 0.1585), 6) + 0.0 AS low, round(quantile_cont(y, 0.8415), 6) + 0.0 AS high FROM (SELECT ({BINS.replace('{x}', 'value')})::BIGINT AS bin, user_id::DOUBLE AS y FROM events) WHERE bin IS NOT NULL GROUP BY bin""")
def skeleton(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("y", F.col("user_id").cast("double"))
    return rounded(statistics.skeleton(e, "value", "y", EDGES))


GRID = [k / 8 for k in range(9)]


@query("SELECT floor(x * 8)::BIGINT AS i, floor(y * 8)::BIGINT AS j, count(*) AS n FROM {pts} GROUP BY i, j")
def density_2d(spark, sf_dir):
    return statistics.density_2d(views.pts(spark, sf_dir), "x", "y", GRID, GRID)


@query("""WITH n AS (SELECT count(*) AS n FROM {pts} GROUP BY floor(x * 8), floor(y * 8)), f AS (SELECT n, sum(n) OVER (ORDER BY n DESC ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS f FROM n)
    SELECT percent, arg_min(n, (round(abs(f - percent), 12), -n)) AS level FROM f, (SELECT unnest([0.3, 0.6, 0.9])::DOUBLE AS percent) GROUP BY percent""")
def percent_levels(spark, sf_dir):
    cells = statistics.density_2d(views.pts(spark, sf_dir), "x", "y", GRID, GRID)
    return statistics.percent_levels(cells, "n", [0.3, 0.6, 0.9])


HALO = "(CASE halo WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END)"


def _members(spark, sf_dir):
    names = F.when(F.col("halo") == "click", 1).when(F.col("halo") == "view", 2).when(F.col("halo") == "purchase", 3).otherwise(4)
    return views.steps(spark, sf_dir).select("snapshot", "id", names.cast("long").alias("halo_id"))


@query(f"SELECT {HALO} + 5 * 10000000000000000 AS branch, count(*) AS n FROM {{steps}} WHERE snapshot = 5 GROUP BY branch")
def branch_counts(spark, sf_dir):
    members = _members(spark, sf_dir).where("snapshot = 5")
    return branches.counts(branches.branch_ids(members.select("id"), members.select("id", "halo_id"), 5))


@query(f"SELECT arg_max(branch, n * 10 - branch % 10) AS branch FROM (SELECT {HALO} + 5 * 10000000000000000 AS branch, count(*) AS n FROM {{steps}} WHERE snapshot = 5 GROUP BY branch)")
def main_branch(spark, sf_dir):
    members = _members(spark, sf_dir).where("snapshot = 5")
    return branches.main_branch(branches.branch_ids(members.select("id"), members.select("id", "halo_id"), 5))


def branch_follow(spark, sf_dir):
    """Backward fold; the main branch depends on what is left, which SQL cannot express."""
    members = _members(spark, sf_dir)
    snapshots = [r.snapshot for r in members.select("snapshot").distinct().collect()]
    return branches.follow(members.select("id").distinct(), members, snapshots)


QUERIES["branch_follow"] = branch_follow


FACTORS = "list_max(list_filter(range(1, floor({n} ** (1 / {k}::DOUBLE) + 1e-9)::BIGINT + 1), lambda d: {n} % d = 0))"


@query(f"""SELECT id, f1, f2, n // f1 // f2 AS f3 FROM (SELECT *, {FACTORS.format(n="(n // f1)", k=2)} AS f2 FROM
    (SELECT *, {FACTORS.format(n="n", k=3)} AS f1 FROM (SELECT p_partkey AS id, p_size * (1 + p_partkey % 40) AS n FROM part)))""")
def near_factors(spark, sf_dir):
    n = F.col("p_size") * (1 + F.col("p_partkey") % 40)
    found = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), numbers.near_factors(n, 3).alias("f"))
    return found.select("id", *(F.col("f")[k].alias(f"f{k + 1}") for k in range(3)))


@query("SELECT bin, count(*) AS n FROM (SELECT greatest(least(floor(ln(o_totalprice / 900) / ln(600000 / 900.0) * 24), 24), -1)::BIGINT AS bin FROM orders) GROUP BY bin")
def log_histogram(spark, sf_dir):
    """Numbers between logarithmic edges; -1 and 24 lie outside."""
    edges = F.array(*(F.lit(x) for x in numbers.log_edges(900.0, 600000.0, 25)))
    place = F.size(F.filter(edges, lambda e: e <= F.col("o_totalprice"))) - 1
    return table(spark, sf_dir, "orders").groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT track, least(greatest(floor(count(*) * 0.25), 2), count(*))::BIGINT AS core FROM {cat} GROUP BY track")
def core_size(spark, sf_dir):
    sizes = views.cat(spark, sf_dir).groupBy("track").agg(F.count("*").alias("n"))
    return sizes.select("track", numbers.core_size(F.col("n"), 0.25, 2).alias("core"))


BASIS = """SELECT id, {out} FROM (SELECT *, sqrt(dx * dx + dy * dy) AS p, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM
    (SELECT id, CASE WHEN id % 7 = 0 THEN 0 ELSE x - 0.5 END AS dx, CASE WHEN id % 7 = 0 THEN 0 ELSE y - 0.5 END AS dy, CASE WHEN id % 5 = 0 THEN 0 ELSE z - 0.5 END AS dz FROM {{pts}}))"""
MODE = "sqrt(p * p + p * p * p * p / dz / dz)"
VECTORS = {
    "rx": "CASE WHEN r > 0 THEN dx / r END", "ry": "CASE WHEN r > 0 THEN dy / r END", "rz": "CASE WHEN r > 0 THEN dz / r END",
    "ax": "CASE WHEN p = 0 THEN 1 ELSE -dy / p END", "ay": "CASE WHEN p = 0 THEN 0 ELSE dx / p END", "az": "0.0::DOUBLE",
    "mx": f"CASE WHEN p = 0 OR dz = 0 THEN 0 ELSE -dx / {MODE} END", "my": f"CASE WHEN p = 0 THEN 1 WHEN dz = 0 THEN 0 ELSE -dy / {MODE} END",
    "mz": f"CASE WHEN p = 0 THEN 0 WHEN dz = 0 THEN 1 ELSE p * p / dz / {MODE} END",
}


@query(BASIS.format(out=", ".join(f"{r(f'({x})')} AS {c}" for c, x in VECTORS.items())))
def spherical_axes(spark, sf_dir):
    p = views.pts(spark, sf_dir)
    at = lambda c, k: F.when(F.col("id") % k == 0, F.lit(0.0)).otherwise(F.col(c) - 0.5).alias(f"d{c}")
    basis = geo.spherical_basis(F.col("dx"), F.col("dy"), F.col("dz"))
    found = p.select("id", at("x", 7), at("y", 7), at("z", 5))
    return rounded(found.select("id", *(v[k].alias(f"{name[0]}{c}") for name, v in basis.items() for k, c in enumerate("xyz"))))


E2 = "(om / a ** 3 + (1 - om - ol) / (a * a) + ol)"
X1 = f"(om / a ** 3 / {E2} - 1)"


@query(f"""SELECT id, {r(f"100 * sqrt{E2}", 5)} AS hubble, {r(f"om / a ** 3 / {E2}", 5)} AS omega, {r(f"18 * 3.1416::DOUBLE * 3.1416::DOUBLE + 82 * {X1} - 39 * {X1} * {X1}", 5)} AS tophat,
    {r(f"200 * (om / a ** 3 / {E2})", 5)} AS mean200 FROM (SELECT p_partkey AS id, 1 / (1 + p_size / 10.0::DOUBLE) AS a, 0.2 + (p_partkey % 5) / 20.0::DOUBLE AS om, 0.7::DOUBLE AS ol FROM part)""")
def expansion(spark, sf_dir):
    om = (F.lit(0.2) + (F.col("p_partkey") % 5) / 20.0).alias("om")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (1 / (1 + F.col("p_size") / 10.0)).alias("a"), om, F.lit(0.7).alias("ol"))
    p = p.withColumn("omega", cosmology.omega_at(F.col("om"), F.col("ol"), F.col("a")))
    virial = cosmology.virial_factors(F.col("omega"))
    hubble = cosmology.hubble(F.col("om"), F.col("ol"), F.col("a"), 100.0).alias("hubble")
    return rounded(p.select("id", hubble, "omega", virial["tophat"].alias("tophat"), virial["mean200"].alias("mean200")), 5)


@query("SELECT track, round((3 * count(*) / (4 * pi() * (1 + track % 3))) ** (1 / 3.0::DOUBLE), 6) + 0.0 AS radius FROM {cat} GROUP BY track")
def neighbour_range(spark, sf_dir):
    sizes = views.cat(spark, sf_dir).groupBy("track").agg(F.count("*").alias("n"))
    return rounded(sizes.select("track", geo.neighbour_range(F.col("n"), 1 + F.col("track") % 3).alias("radius")))


OUTSIDE = "(({n}) * 4.0::DOUBLE / 20000) ** (1 / 3.0::DOUBLE)"


@query(f"""WITH RECURSIVE p AS MATERIALIZED (SELECT halo_id, r FROM {PROFILE}), s AS (SELECT halo_id, count(*) AS size, count(*) AS n, {OUTSIDE.format(n="count(*)")} AS guess, FALSE AS done FROM p GROUP BY halo_id
    UNION ALL SELECT halo_id, size, n, {OUTSIDE.format(n="n")}, n IN (0, size) OR abs({OUTSIDE.format(n="n")} - guess) < 1e-5 * {OUTSIDE.format(n="n")}
    FROM (SELECT halo_id, size, guess, count(*) FILTER (r < guess) AS n FROM s JOIN p USING (halo_id) WHERE NOT done GROUP BY halo_id, size, guess))
    SELECT halo_id, n * 4.0::DOUBLE AS mass_in, round(guess, 6) + 0.0 AS radius_in FROM s WHERE done""")
def overdensity_from_outside(spark, sf_dir):
    prof = aggregates.profile(_groups(spark, sf_dir), "halo_id", "id", BOX, 0.01)
    return rounded(aggregates.overdensity_from_outside(prof, "halo_id", 20000.0, 4.0))


BOUND = unbinding.Physics(1.4e-5, 0.02, SCALE, HUBBLE, BOX, 10, 0.995, 0, 1.2)
SIZE = 64
STATE = ("x", "y", "z", "vx", "vy", "vz")
SOFT = 2.8 * BOUND.softening
U = f"(o.s / {SOFT})"
PHI = f"""CASE WHEN o.s >= {SOFT} THEN -1 / o.s WHEN o.s < {SOFT / 2} THEN (-2.8::DOUBLE + {U} * {U} * (5.333333333333 + {U} * {U} * (-9.6 + {U} * 6.4))) / {SOFT}
    ELSE (-3.2::DOUBLE + 0.066666666667 / {U} + {U} * {U} * (10.666666666667 + {U} * (-16.0 + {U} * (9.6 - {U} * 2.133333333333)))) / {SOFT} END"""


def _frames(rows: str, extra: str) -> str:
    """Rows with the mean place and velocity of their group, seen from its first member."""
    part = "OVER (PARTITION BY grp)"
    means = [f"o{c} + sum(m * {near(f'{c} - o{c}')}) {part} / sum(m) {part} AS f{c}" for c in "xyz"] + [f"sum(m * {c}) {part} / sum(m) {part} AS f{c}" for c in V]
    first = ", ".join(f"first_value({c}) OVER (PARTITION BY grp ORDER BY k) AS o{c}" for c in "xyz")
    return f"SELECT grp, k, id, {', '.join(STATE)}, m, {', '.join(means)}, {extra} FROM (SELECT *, {first} FROM {rows})"


def _energies(rows: str) -> str:
    """Rows with ``e``: kinetic energy in the group's frame and the potential of the group's other members."""
    d = [near(f"{c} - o.{c}") for c in "xyz"]
    apart = f"list_transform(list_filter(others, lambda o: o.id <> id), lambda o: struct_pack(m := o.m, s := sqrt({' + '.join(f'{x} * {x}' for x in d)})))"
    phi = f"coalesce(list_sum(list_transform(apart, lambda o: o.m * ({PHI}))), 0)"
    flow = [f"(v{c} - fv{c} + {HUBBLE} * {SCALE} * {near(f'{c} - f{c}')})" for c in "xyz"]
    kinetic = f"0.5 * ({' + '.join(f'{x} * {x}' for x in flow)})"
    others = "list(struct_pack(id := id, x := x, y := y, z := z, m := m)) OVER (PARTITION BY grp) AS others"
    return f"SELECT * EXCLUDE (others, apart), {kinetic} + {phi} * {BOUND.g} / {SCALE} AS e FROM (SELECT *, {apart} AS apart FROM (SELECT *, {others} FROM {rows}))"


def _unbound(tag: str, source: str) -> str:
    """CTEs: ``{tag}`` (grp, ord, id, is_bound, energy, nbound) of ``source`` (grp, k, id, place, velocity, m)."""
    live = f"(SELECT * EXCLUDE e FROM {tag}_s WHERE NOT done)"
    stay = f"(SELECT *, count(*) FILTER (e < 0) OVER (PARTITION BY grp) AS n, count(*) OVER (PARTITION BY grp) AS size FROM ({_energies(live)}))"
    fit = f"(SELECT * FROM {stay} WHERE e < 0 AND n >= {BOUND.least})"
    return f"""{tag}_i AS MATERIALIZED ({source}), {tag}_s AS ({_frames(f"{tag}_i", "0.0::DOUBLE AS e, FALSE AS done")}
        UNION ALL {_frames(fit, f"e, n >= {BOUND.precision} * size AS done")}),
    {tag}_b AS MATERIALIZED (SELECT * FROM {tag}_s WHERE done),
    {tag}_l AS MATERIALIZED (SELECT i.*, {", ".join(f"f.f{c}" for c in STATE)} FROM {tag}_i i JOIN (SELECT grp, {", ".join(f"any_value(f{c}) AS f{c}" for c in STATE)} FROM {tag}_b GROUP BY grp) f USING (grp)),
    {tag} AS MATERIALIZED (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY is_bound DESC, energy, id) - 1 AS ord, id, is_bound, energy, count(*) FILTER (is_bound) OVER (PARTITION BY grp) AS nbound
        FROM (SELECT l.grp, l.id, b.id IS NOT NULL AS is_bound, coalesce(b.e, l.e) AS energy FROM ({_energies(f"{tag}_l")}) l LEFT JOIN {tag}_b b USING (grp, id))
        UNION ALL SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY k) - 1, id, row_number() OVER (PARTITION BY grp ORDER BY k) = 1, 0.0, 1 FROM {tag}_i WHERE grp NOT IN (SELECT grp FROM {tag}_b))"""


ROWS = "id, x, y, z, vx, vy, vz, mass AS m"


@query(f"WITH RECURSIVE {_unbound('u', f'SELECT id // {SIZE} AS grp, id AS k, {ROWS} FROM {{pts}}')} SELECT grp, ord, id, is_bound, {r('energy')} AS energy FROM u")
def unbind(spark, sf_dir):
    p = views.pts(spark, sf_dir).withColumn("grp", F.floor(F.col("id") / SIZE)).withColumn("ord", F.col("id"))
    return rounded(unbinding.unbind_groups(p, "grp", BOUND))


#: Nests of two lists: of each 2 * SIZE points the last 40 belong to a list below that of the others.
SPLIT = 2 * SIZE - 40
LISTED = f"(SELECT *, 2 * (id // {2 * SIZE}) + (id % {2 * SIZE} >= {SPLIT})::BIGINT AS grp FROM {{pts}})"
STARS = "a.id, a.x, a.y, a.z, a.vx, a.vy, a.vz, a.m"
LIMIT = f"(CASE WHEN nbound <= 1 THEN 1 ELSE floor(nbound * {BOUND.relax}::DOUBLE) END)"
NEST = f"""RECURSIVE a AS MATERIALIZED (SELECT grp, {ROWS} FROM {LISTED}), {_unbound("c", f"SELECT grp, id AS k, {STARS} FROM a WHERE grp % 2 = 1")},
    {_unbound("p", f'''SELECT g.grp, row_number() OVER (PARTITION BY g.grp ORDER BY part, g.ord) - 1 AS k, {STARS}
        FROM (SELECT grp, 0 AS part, id AS ord, id FROM a WHERE grp % 2 = 0 UNION ALL SELECT grp - 1, 1, ord, id FROM c WHERE NOT is_bound) g JOIN a USING (id)''')},
    kc AS (SELECT * FROM c WHERE ord < {LIMIT}), kp AS (SELECT * FROM p WHERE ord < {LIMIT})"""
CLOSE = [near(f"b.{c} - t.{c}") for c in "xyz"]
OFF = {**{c: near(f"x.{c} - x.o{c}") for c in "xyz"}, **{c: f"(x.{c} - x.o{c})" for c in V}}
TOP = f"""SELECT grp, {", ".join(f"any_value(o{c}) + sum(m * {d}) / sum(m) AS {c}" for c, d in OFF.items())},
    {", ".join(f"sqrt(greatest(0, {' + '.join(f'sum(m * {OFF[c]} * {OFF[c]}) / sum(m) - (sum(m * {OFF[c]}) / sum(m)) ** 2' for c in part)})) AS {name}" for name, part in (("sx", "xyz"), ("sv", V)))}
    FROM (SELECT g.grp, {STARS}, {", ".join(f"first_value(a.{c}) OVER (PARTITION BY g.grp ORDER BY g.ord) AS o{c}" for c in STATE)}
        FROM kp g JOIN a USING (id) WHERE g.ord < least(nbound, 20) AND nbound > 1) x GROUP BY grp"""
SINK = f"""t AS MATERIALIZED (SELECT b.grp, b.nbound FROM (SELECT g.grp, g.nbound, {", ".join(f"a.{c}" for c in STATE)} FROM kc g JOIN a USING (id) WHERE g.ord = 0) b JOIN ({TOP}) t ON t.grp = b.grp - 1
    WHERE sx > 0 AND sv > 0 AND sqrt({" + ".join(f"{x} * {x}" for x in CLOSE)}) / sx + sqrt({" + ".join(f"(b.{c} - t.{c}) ** 2" for c in V)}) / sv < 2)"""
MERGED = f"""SELECT g.grp, row_number() OVER (PARTITION BY g.grp ORDER BY part, g.ord) - 1 AS k, {STARS} FROM (SELECT * FROM
    (SELECT grp, CASE WHEN is_bound THEN 0 ELSE 2 END AS part, ord, id FROM kp UNION ALL SELECT grp - 1, 1, ord, id FROM kc) WHERE grp + 1 IN (SELECT grp FROM t WHERE nbound > 1)
    QUALIFY row_number() OVER (PARTITION BY grp, id ORDER BY part, ord) = 1) g JOIN a USING (id)"""


def _nests(spark, sf_dir, merge):
    p = views.pts(spark, sf_dir).withColumn("nest", F.floor(F.col("id") / (2 * SIZE)))
    child = F.col("id") % (2 * SIZE) >= SPLIT
    p = p.withColumn("track", 2 * F.col("nest") + child.cast("long")).withColumn("parent", F.when(child, 2 * F.col("nest"))).withColumn("ord", F.col("id"))
    return unbinding.resolve_nests(p, "nest", BOUND, merge)


@query(f"WITH {NEST} SELECT grp // 2 AS nest, grp AS track, ord, id, is_bound, nbound, -1::BIGINT AS sink FROM (SELECT * FROM kc UNION ALL SELECT * FROM kp)")
def recursive_unbind(spark, sf_dir):
    """What a list below loses feeds the list above before that is unbound."""
    return _nests(spark, sf_dir, False)


@query(f"""WITH {NEST}, {SINK}, {_unbound("m", MERGED)} SELECT grp // 2 AS nest, grp AS track, ord, id, is_bound, nbound, sink FROM (
    SELECT grp, ord, id, is_bound, nbound, -1::BIGINT AS sink FROM kp WHERE grp NOT IN (SELECT grp FROM m) UNION ALL SELECT grp, ord, id, is_bound, nbound, -1 FROM m WHERE ord < {LIMIT}
    UNION ALL SELECT grp, ord, id, is_bound, nbound, -1 FROM kc WHERE grp NOT IN (SELECT grp FROM t) UNION ALL SELECT grp, ord, id, is_bound, 1, grp - 1 FROM kc WHERE ord = 0 AND grp IN (SELECT grp FROM t))""")
def merge_trapped(spark, sf_dir):
    """A list whose first member lies in the core of the list above ends there; the joined list is unbound again."""
    return _nests(spark, sf_dir, True)
