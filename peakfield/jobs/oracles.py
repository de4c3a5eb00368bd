"""The same results in SQL that DuckDB runs on the driver's tables."""

from __future__ import annotations

P = """p AS (
  SELECT 'events' AS run_id, event_id AS point_id, CAST(user_id AS INTEGER) AS meta1, value AS mz,
    CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 1000000 AS FLOAT) AS rt,
    CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS DOUBLE) AS intensity
  FROM events
)"""
OUT = "run_id, point_id, meta1, mz, CAST(rt AS DOUBLE) AS rt, intensity"
IN_BOX = "mz >= 5 AND mz <= 60 AND rt >= CAST(3600 AS FLOAT) AND rt <= CAST(2000000 AS FLOAT)"
RANGES = "min(mz) AS mz_min, max(mz) AS mz_max, CAST(min(rt) AS DOUBLE) AS rt_min, CAST(max(rt) AS DOUBLE) AS rt_max, min(intensity) AS int_min, max(intensity) AS int_max"
CAPACITY, HEIGHT, N = 512, 2, 777

SPECTRA = """s AS (
  SELECT run_id, CAST(meta1 AS BIGINT) AS spectrum_index, CAST(meta1 % 3 AS INTEGER) AS ms_level, CAST(min(rt) AS DOUBLE) AS rt, count(*) AS n_peaks,
    count(*) FILTER (intensity >= 50) AS n_strong, max(intensity) AS int_max
  FROM p GROUP BY run_id, meta1
)"""
ASKED = """v AS (
  SELECT s_suppkey AS viewport_id, abs(s_acctbal / 100) AS mz_min, abs(s_acctbal / 100) + 10 AS mz_max, CAST(s_suppkey * 7919 % 50000 AS FLOAT) AS rt_min,
    CAST(CAST(s_suppkey * 7919 % 50000 AS FLOAT) + CAST(1000000 AS FLOAT) AS FLOAT) AS rt_max, CAST(s_suppkey % 40 AS INTEGER) AS num_points
  FROM supplier
), q AS (
  SELECT viewport_id, num_points, CASE WHEN mz_min = 0 THEN '-inf'::DOUBLE ELSE mz_min END AS q1, mz_max AS q2, CASE WHEN rt_min = 0 THEN '-inf'::FLOAT ELSE rt_min END AS q3, rt_max AS q4 FROM v
)"""
CFG = f"""cfg AS (
  SELECT leaves, (SELECT min(b) FROM range(1, 5000) t(b) WHERE power(b, {HEIGHT}) >= leaves) AS k
  FROM (SELECT CAST(ceil(max(c) / {CAPACITY}.0) AS BIGINT) AS leaves FROM (SELECT count(*) AS c FROM p GROUP BY run_id))
)"""
#: The points that an import of mzML files, four runs, has: odd spectra are stored in 32 bits.
IMPORTED = f"""{P.replace("p AS", "p0 AS", 1)}, s0 AS (SELECT meta1 AS u, min(rt) AS start FROM p0 GROUP BY meta1), p AS (
  SELECT CAST(meta1 % 4 AS VARCHAR) AS run_id, row_number() OVER (ORDER BY CAST(meta1 % 4 AS VARCHAR), meta1, point_id) - 1 AS point_id, 0 AS meta1,
    CASE WHEN meta1 % 2 = 0 THEN mz ELSE CAST(CAST(mz AS FLOAT) AS DOUBLE) END AS mz, start AS rt, intensity
  FROM p0 JOIN s0 ON meta1 = u WHERE meta1 % 3 IN (0, 1)
)"""
#: The points that an import of one mzML file has.
ONE_RUN = IMPORTED.replace("ORDER BY CAST(meta1 % 4 AS VARCHAR), meta1, point_id", "ORDER BY meta1, point_id")
#: The points in four batches, each with a tree of its own.
BATCHES = f"""{P.replace("p AS", "p0 AS", 1)}, p AS (SELECT CAST(point_id % 4 AS VARCHAR) AS run_id, point_id, meta1, mz, rt, intensity FROM p0)"""


def tile_ctes(source: str = P, config: str = CFG) -> str:
    """t0 .. t{HEIGHT}: the points with tile_id and leaf_depth after each round."""
    parts = [source, config, "t0 AS (SELECT *, CAST(0 AS BIGINT) AS tile_id, 0 AS leaf_depth FROM p)"]
    for d in range(HEIGHT):
        axis = "rt" if d % 2 == 0 else "mz"
        parts.append(f"""r{d} AS (SELECT *, count(*) OVER (PARTITION BY run_id, leaf_depth, tile_id) AS n, row_number() OVER (PARTITION BY run_id, leaf_depth, tile_id ORDER BY {axis}, point_id) - 1 AS idx FROM t{d}),
t{d + 1} AS (
  SELECT run_id, point_id, meta1, mz, rt, intensity,
    CASE WHEN leaf_depth = {d} AND n > {CAPACITY} THEN CAST(tile_id * k + idx // CAST(ceil(CAST(n AS DOUBLE) / k) AS BIGINT) AS BIGINT) ELSE tile_id END AS tile_id,
    CASE WHEN leaf_depth = {d} AND n > {CAPACITY} THEN {d + 1} ELSE leaf_depth END AS leaf_depth
  FROM r{d}, cfg
)""")
    parts.append(f"t AS (SELECT * FROM t{HEIGHT})")
    return ",\n".join(parts)


TILES = tile_ctes()
TABLE = f"""d AS (SELECT CAST(unnest(range(0, {HEIGHT + 1})) AS INTEGER) AS depth),
tt AS (
  SELECT run_id, depth, CAST(tile_id // CAST(power(k, leaf_depth - depth) AS BIGINT) AS BIGINT) AS tile_id, k,
    count(*) AS n_points, bool_or(leaf_depth = depth) AS is_leaf, {RANGES}
  FROM t, cfg, d WHERE depth <= leaf_depth GROUP BY ALL
),
tiles AS (SELECT run_id, depth, tile_id, CASE WHEN depth > 0 THEN tile_id // k END AS parent_id, is_leaf, n_points, mz_min, mz_max, rt_min, rt_max, int_min, int_max FROM tt)"""
TILE_OUT = "run_id, depth, tile_id, parent_id, is_leaf, n_points, mz_min, mz_max, rt_min, rt_max, int_min, int_max"
LEAVES = f"leaves AS (SELECT leaf_depth, tile_id, {RANGES}, count(*) AS n_points FROM t GROUP BY leaf_depth, tile_id)"


def level_ctes() -> str:
    """l{d}: the points with lod after the summary of depth d."""
    parts = [f"l{HEIGHT} AS (SELECT *, leaf_depth AS lod FROM t)"]
    for d in reversed(range(HEIGHT)):
        parts.append(f"""g{d} AS (
  SELECT l.*, row_number() OVER (PARTITION BY run_id, (leaf_depth > {d} AND lod = {d + 1}), tile_id // CAST(power(k, greatest(0, leaf_depth - {d})) AS BIGINT) ORDER BY intensity DESC, point_id DESC) AS pick
  FROM l{d + 1} l, cfg
), l{d} AS (
  SELECT run_id, point_id, meta1, mz, rt, intensity, tile_id, leaf_depth, CASE WHEN leaf_depth > {d} AND lod = {d + 1} AND pick <= {CAPACITY} THEN {d} ELSE lod END AS lod FROM g{d}
)""")
    return ",\n".join([*parts, "l AS (SELECT * FROM l0)"])


LEVELS = f"{TILES},\n{level_ctes()}"


def uniform(keys: str, seed: int = 7) -> str:
    return f"((CAST('0x' || substr(md5('{seed}:' || {keys}), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def weighted(source: str, group: str, n: int | str, columns: str, tag: str = "") -> str:
    """The walk in closed form, with plain windows: the table picked, with ``tag`` behind all names. n: a number or a column."""
    i, j, s, f, c, h, k, m = (x + tag for x in "ijsfchkm")
    return f"""
{i} AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY point_id) - 1 AS idx, count(*) OVER (PARTITION BY {group}) AS n, sum(intensity) OVER (PARTITION BY {group}) AS w FROM {source}),
{j} AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY idx % 43, idx // 43) AS j FROM {i}),
{s} AS (SELECT *, sum(intensity) OVER (PARTITION BY {group} ORDER BY j) AS s FROM {j}),
{f} AS (SELECT *, CASE WHEN w > 0 THEN least({n}, CAST(floor((s + 1e-5::DOUBLE) * {n} / w) AS BIGINT)) ELSE least({n}, j) END AS f FROM {s}),
{c} AS (SELECT *, j + least(0, min(f - j) OVER (PARTITION BY {group} ORDER BY j)) AS c FROM {f}),
{h} AS (SELECT *, c - lag(c, 1, 0) OVER (PARTITION BY {group} ORDER BY j) AS hit, max(c) OVER (PARTITION BY {group}) AS taken FROM {c}),
{k} AS (SELECT *, CASE WHEN hit = 0 THEN row_number() OVER (PARTITION BY {group}, hit ORDER BY j) - 1 END AS skip FROM {h}),
{m} AS (SELECT *, CASE WHEN hit = 0 THEN row_number() OVER (PARTITION BY {group}, hit ORDER BY skip % 43, skip // 43) END AS again FROM {k}),
picked{tag} AS (SELECT {columns} FROM {m} WHERE n <= {n} OR hit = 1 OR again <= {n} - taken)"""


def weighted_level_ctes() -> str:
    """level_ctes, summarized by weighted strides."""
    parts = [f"l{HEIGHT} AS (SELECT *, leaf_depth AS lod FROM t)"]
    for d in reversed(range(HEIGHT)):
        parts.append(f"g{d} AS (SELECT l.*, tile_id // CAST(power(k, leaf_depth - {d}) AS BIGINT) AS up FROM l{d + 1} l, cfg WHERE leaf_depth > {d} AND lod = {d + 1})")
        parts.append(weighted(f"g{d}", "run_id, up", CAPACITY, "run_id, point_id, true AS rose", f"_{d}"))
        parts.append(f"""l{d} AS (
  SELECT run_id, point_id, meta1, mz, rt, intensity, tile_id, leaf_depth, CASE WHEN rose THEN {d} ELSE lod END AS lod FROM l{d + 1} LEFT JOIN picked_{d} USING (run_id, point_id)
)""")
    return ",\n".join([*parts, "l AS (SELECT * FROM l0)"])


WEIGHTED = f"{TILES},\n{weighted_level_ctes()}"
FRACTIONS = f"{P.replace('p AS', 'p0 AS', 1)}, p AS (SELECT * REPLACE (intensity / 7 + mz / 1000 AS intensity) FROM p0)"


def limb_sum(value: str, unit: str, over: str = "") -> str:
    """A sum as whole numbers in units of powers of two."""
    step = f"({unit} / 2147483648)"
    high = f"CAST(floor({value} / {step}) AS BIGINT)"
    low = f"CAST(floor(({value} - floor({value} / {step}) * {step}) / {step} * 2147483648) AS BIGINT)"
    return f"(CAST(sum({high}){over} AS DOUBLE) * {step} + CAST(sum({low}){over} AS DOUBLE) * ({step} / 2147483648))"


def unit(largest: str) -> str:
    return f"power(2.0::DOUBLE, ceil(log2({largest})) + 1)"


def drawn(source: str, group: str, n: str, seed: int = 7) -> str:
    """The table drawn: n draws of each group by geometric gaps."""
    u = uniform("j || ':' || point_id", seed)
    return f"""a AS (SELECT *, CAST({n} AS DOUBLE) AS want, {limb_sum("intensity", "u", f" OVER (PARTITION BY {group})")} AS w FROM (SELECT *, {unit("max(intensity) OVER (PARTITION BY " + group + ")")} AS u FROM {source})),
b AS (SELECT *, least(1.0::DOUBLE, intensity * want / w / 2) AS pr FROM a),
c AS (SELECT *, CAST(ceil((want + 8 * sqrt(want) + 20) / sum(pr) OVER (PARTITION BY {group})) AS BIGINT) AS passes FROM b),
e AS (SELECT *, unnest(range(0, least(passes, CAST(ceil(passes * pr + 12 * sqrt(passes * pr) + 40) AS BIGINT)))) AS j FROM c),
f AS (SELECT *, CASE WHEN pr >= 1 THEN 0 ELSE CAST(floor(ln({u}) / CASE WHEN pr < 1e-8 THEN -pr ELSE ln(1 - pr) END) AS BIGINT) END AS gap FROM e),
g AS (SELECT *, CAST(sum(gap + 1) OVER (PARTITION BY {group}, point_id ORDER BY j) - 1 AS BIGINT) AS pass FROM f),
drawn AS (SELECT * FROM g WHERE pass < passes QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY pass, point_id) <= want)"""


FIXED = "cfg AS (SELECT 8 AS k)"
#: The trees of four batches below one root.
JOINED = f"""{tile_ctes(BATCHES, FIXED)},
{level_ctes()},
jr AS (SELECT *, row_number() OVER (PARTITION BY lod = 0 ORDER BY intensity DESC, point_id DESC) AS root FROM l),
jl AS (SELECT 'events' AS run_id, point_id, meta1, mz, rt, intensity, leaf_depth + 1 AS leaf_depth, CASE WHEN lod = 0 AND root <= {CAPACITY} THEN 0 ELSE lod + 1 END AS lod FROM jr)"""


def first(n: int, order: str, group: str = "run_id") -> str:
    return f"WITH {P} SELECT {OUT} FROM p QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY {order}) <= {n}"


ITEMS = """i0 AS (
  SELECT l_returnflag AS run_id, l_linenumber AS meta1, l_extendedprice AS mz, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS FLOAT) AS rt, l_quantity AS intensity, l_orderkey, l_partkey, l_suppkey FROM lineitem
), items AS (
  SELECT run_id, row_number() OVER (ORDER BY run_id, rt, mz, meta1, intensity, l_orderkey, l_partkey, l_suppkey) - 1 AS point_id, meta1, mz, rt, intensity FROM i0
)"""
VIEWED = """hit AS (
  SELECT viewport_id, num_points, l.* FROM l JOIN q ON mz BETWEEN q1 AND q2 AND rt BETWEEN q3 AND q4
), upto AS (
  SELECT viewport_id, num_points, lod, sum(count(*)) OVER (PARTITION BY viewport_id ORDER BY lod) AS n FROM hit GROUP BY viewport_id, num_points, lod
), enough AS (
  SELECT viewport_id, min(lod) AS depth FROM upto WHERE num_points > 0 AND n >= num_points GROUP BY viewport_id
), seen AS (
  SELECT hit.*, row_number() OVER (PARTITION BY hit.viewport_id ORDER BY intensity DESC, point_id DESC) AS pick FROM hit LEFT JOIN enough USING (viewport_id) WHERE depth IS NULL OR lod <= depth
)"""
ORDER_IDS = "ids AS (SELECT o_orderkey % 20000 AS point_id FROM orders)"


def shown_sql(levels: str, n: int, table: str = "l") -> str:
    """b: the points in the window; e: the depth that shows n of them."""
    return f"""WITH {levels}, b AS (SELECT * FROM {table} WHERE {IN_BOX}),
u AS (SELECT lod, sum(count(*)) OVER (ORDER BY lod) AS n FROM b GROUP BY lod), e AS (SELECT min(lod) AS depth FROM u WHERE n >= {n})"""


def window_sql(n: int, levels: str = LEVELS, table: str = "l") -> str:
    return f"""{shown_sql(levels, n, table)}
SELECT {OUT} FROM b, e WHERE depth IS NULL OR lod <= depth QUALIFY row_number() OVER (ORDER BY intensity DESC, point_id DESC) <= {n} OR (SELECT depth FROM e) IS NULL"""


def weighted_window_sql(n: int) -> str:
    return f"""{shown_sql(WEIGHTED, n)}, x AS (SELECT b.* FROM b, e WHERE lod <= depth), {weighted("x", "run_id", n, OUT)}
SELECT * FROM picked UNION ALL SELECT {OUT} FROM b WHERE (SELECT depth FROM e) IS NULL"""


def weighted_windows_sql() -> str:
    return f"""WITH {WEIGHTED}, {ASKED}, {VIEWED}, x AS (SELECT * EXCLUDE (pick) FROM seen WHERE num_points > 0), {weighted("x", "viewport_id", "num_points", "viewport_id, point_id, lod")}
SELECT * FROM picked UNION ALL SELECT viewport_id, point_id, lod FROM seen WHERE num_points = 0"""


def sql() -> dict[str, str]:
    tile_rows = f"SELECT {TILE_OUT} FROM tiles"
    return {
        "query_viewport": window_sql(300),
        "query_viewports": f"WITH {LEVELS}, {ASKED}, {VIEWED} SELECT viewport_id, point_id, lod FROM seen WHERE num_points = 0 OR pick <= num_points",
        "build_pyramid_weighted": f"WITH {WEIGHTED} SELECT run_id, point_id, tile_id, leaf_depth, lod FROM l",
        "mzml_source": f"WITH {P}, {SPECTRA} SELECT spectrum_index, ms_level, rt, 'second' AS rt_unit, n_peaks, int_max FROM s WHERE ms_level IN (0, 1) AND rt > 100",
        "cut_import": f"WITH {ONE_RUN} SELECT point_id, mz, CAST(rt AS DOUBLE) AS rt, intensity FROM p QUALIFY row_number() OVER (ORDER BY intensity DESC, point_id DESC) <= {CAPACITY}",
        "cut_import_summary": f"WITH {ONE_RUN} SELECT {RANGES}, count(*) AS point_count FROM p",
        "cut_records": f"WITH {P} SELECT {RANGES}, count(*) AS point_count FROM p",
        "joined_tree_weighted": f"""WITH {tile_ctes(BATCHES, FIXED)}, {weighted_level_ctes()}, rootl AS (SELECT * FROM l WHERE lod = 0), {weighted("rootl", "1", CAPACITY, "point_id", "_root")}
SELECT l.point_id, leaf_depth + 1 AS leaf_depth, CASE WHEN r.point_id IS NULL THEN lod + 1 ELSE 0 END AS lod FROM l LEFT JOIN picked_root r USING (point_id)""",
        "stride_weighted_fractions": f"WITH {FRACTIONS}, {weighted('p', 'run_id', N, 'run_id, point_id, meta1, mz, CAST(rt AS DOUBLE) AS rt').replace('sum(intensity) OVER (PARTITION BY run_id) AS w', limb_sum('intensity', 'u', ' OVER (PARTITION BY run_id)') + ' AS w').replace('FROM p)', f'FROM (SELECT *, {unit("max(intensity) OVER ()")} AS u FROM p))').replace('sum(intensity) OVER (PARTITION BY run_id ORDER BY j) AS s', limb_sum('intensity', 'u', ' OVER (PARTITION BY run_id ORDER BY j)') + ' AS s')} SELECT * FROM picked",
        "axis_sums_exact": f"WITH {FRACTIONS}, m AS (SELECT *, {', '.join(f'{unit(f"(SELECT max(CAST({a} AS DOUBLE)) FROM p)")} AS u_{a}' for a in ('mz', 'rt', 'intensity'))} FROM p) SELECT run_id, {', '.join(f'{limb_sum(f"CAST({a} AS DOUBLE)", f"u_{a}")} AS {b}' for a, b in (('mz', 'mz_sum'), ('rt', 'rt_sum'), ('intensity', 'int_sum')))} FROM m GROUP BY run_id, u_mz, u_rt, u_intensity",
        "draw_weighted": f"WITH {P}, {drawn('p', 'run_id', str(N))} SELECT pass, point_id FROM drawn",
        "draw_weighted_by_group": f"WITH {P}, {drawn('p', 'meta1', '(meta1 % 9 + 1)')} SELECT meta1, pass, point_id FROM drawn",
        "summarize_weighted_sampling": f"WITH {P}, {drawn('p', 'run_id', '50')} SELECT {OUT} FROM drawn",
        "summarize_two_step": first(300, "intensity, point_id"),
        "merged_reservoirs": first(N, f"ln({uniform('point_id')}) / intensity DESC, point_id"),
        "compacted": f"WITH {tile_ctes(P, FIXED)}, {weighted_level_ctes()} SELECT point_id, leaf_depth, tile_id, lod FROM l",
        "aggregate_tree": f"""WITH {LEVELS}, d AS (SELECT CAST(unnest(range(0, {HEIGHT + 1})) AS INTEGER) AS depth), n AS (
  SELECT run_id, depth, CAST(tile_id // CAST(power(k, leaf_depth - depth) AS BIGINT) AS BIGINT) AS tile_id, {", ".join(f"count(*) FILTER (lod <= {x}) AS n{x}" for x in range(HEIGHT + 1))} FROM l, cfg, d WHERE depth <= leaf_depth GROUP BY ALL)
SELECT run_id, depth, tile_id, n{HEIGHT} AS n_points, array_to_string([{", ".join(f"n{x}" for x in range(HEIGHT + 1))}], ',') AS shown FROM n""",
        "window_counts": f"WITH {LEVELS}, {ASKED}, {VIEWED} SELECT viewport_id, lod AS depth, CAST(n AS BIGINT) AS n_points FROM upto",
        "level_counts": f"WITH {LEVELS} SELECT run_id, lod AS depth, CAST(sum(count(*)) OVER (PARTITION BY run_id ORDER BY lod) AS BIGINT) AS n_points FROM l WHERE {IN_BOX} GROUP BY run_id, lod",
        "walk_viewports": f"WITH {LEVELS}, {ASKED}, {VIEWED} SELECT viewport_id, point_id, lod FROM seen WHERE num_points = 0 OR pick <= num_points",
        "walk_viewports_weighted": weighted_windows_sql(),
        "query_runs": f"""WITH {tile_ctes(f"{ITEMS}, p AS (SELECT * FROM items)")}, {level_ctes()}, b AS (SELECT * FROM l WHERE mz >= 20000 AND mz <= 60000 AND rt >= -600 AND rt <= 600),
u AS (SELECT run_id, lod, sum(count(*)) OVER (PARTITION BY run_id ORDER BY lod) AS n FROM b GROUP BY run_id, lod), e AS (SELECT run_id, min(lod) AS depth FROM u WHERE n >= 400 GROUP BY run_id)
SELECT {OUT} FROM b LEFT JOIN e USING (run_id) WHERE depth IS NULL OR lod <= depth QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY intensity DESC, point_id DESC) <= 400""",
        "query_viewport_weighted": weighted_window_sql(300),
        "query_viewports_weighted": weighted_windows_sql(),
        "stored_viewport": window_sql(300),
        "joined_tree": f"WITH {JOINED} SELECT point_id, leaf_depth, lod FROM jl",
        "incremental_viewport": window_sql(300, JOINED, "jl"),
        "ingest_mzml": f"WITH {IMPORTED} SELECT run_id AS run, {RANGES}, count(*) AS point_count FROM p GROUP BY run_id",
        "ingest_csv": f"WITH {P} SELECT {RANGES}, CAST(count(*) AS BIGINT) AS point_count FROM p",
        "import_run": f"WITH {tile_ctes(IMPORTED)}, {weighted_level_ctes()} SELECT run_id AS run, point_id, mz, CAST(rt AS DOUBLE) AS rt, intensity, tile_id, leaf_depth, lod FROM l",
        "decode_spectra_widths": f"WITH {P} SELECT CAST(meta1 AS BIGINT) AS spectrum_index, row_number() OVER (PARTITION BY meta1 ORDER BY point_id) - 1 AS position, CASE WHEN meta1 % 2 = 0 THEN mz ELSE CAST(CAST(mz AS FLOAT) AS DOUBLE) END AS mz, intensity FROM p",
        "json_rows_back": f"WITH {P} SELECT point_id, CAST(meta1 AS BIGINT) AS meta1, mz, CAST(rt AS DOUBLE) AS rt, intensity FROM p",
        "build_pyramid": f"WITH {LEVELS} SELECT run_id, point_id, tile_id, leaf_depth, lod FROM l",
        "read_points_csv": f"WITH {P} SELECT meta1, mz, CAST(rt AS DOUBLE) AS rt, intensity FROM p",
        "read_mzml_spectra": f"WITH {P}, {SPECTRA} SELECT spectrum_index, ms_level, rt, 'second' AS rt_unit, CAST(2 AS BIGINT) AS n_arrays FROM s",
        "decode_spectra": f"WITH {P} SELECT CAST(meta1 AS BIGINT) AS spectrum_index, row_number() OVER (PARTITION BY meta1 ORDER BY point_id) - 1 AS position, CAST(CAST(mz AS FLOAT) AS DOUBLE) AS mz, intensity FROM p",
        "read_point_records": f"WITH {P} SELECT point_id, meta1, mz, CAST(rt AS DOUBLE) AS rt, intensity FROM p",
        "write_store": f"WITH {P} SELECT {OUT} FROM p",
        "copy_store": f"WITH {TILES}, {TABLE} {tile_rows}",
        "export_csv": f"WITH {P} SELECT meta1, count(*) AS n_rows, max(mz) AS mz_max, (SELECT count(*) FROM p WHERE {IN_BOX}) AS n_exported FROM p WHERE {IN_BOX} GROUP BY meta1",
        "to_json_rows": f"WITH {P} SELECT '[' || point_id || ',' || meta1 || ',' || CAST(trunc(mz) AS BIGINT) || ',' || CAST(rt AS BIGINT) || ',' || CAST(intensity AS BIGINT) || ']' AS value FROM p ORDER BY point_id LIMIT 500",
        "ingest_stream": f"WITH {P} SELECT run_id, {RANGES}, count(*) AS point_count FROM p GROUP BY run_id",
        "build_incremental": f"WITH {P} SELECT run_id, point_id FROM p ORDER BY intensity DESC, point_id DESC LIMIT 50",  # summaries nest, however files are cut
        "load": f"WITH {P} SELECT meta1, count(*) AS n_points, sum(intensity) AS int_sum FROM p GROUP BY meta1",
        "numbered_import": f"WITH {P} SELECT CAST(count(*) AS BIGINT) AS n_points FROM p WHERE meta1 % 3 IN (0, 1) AND intensity >= 50",
        "filter_min_intensity": f"WITH {P} SELECT {OUT} FROM p WHERE intensity >= 50",
        "filter_ms_level": f"WITH {P}, {SPECTRA} SELECT spectrum_index, ms_level, n_peaks FROM s WHERE ms_level IN (0, 1)",
        "in_box": f"WITH {P} SELECT {OUT} FROM p WHERE {IN_BOX}",
        "validate_box": f"WITH {ASKED} SELECT viewport_id, CASE WHEN mz_max - num_points < mz_min THEN 'mz inverted' WHEN rt_max < rt_min THEN 'rt inverted' END AS reason FROM v",
        "tiles_overlapping": f"WITH {TILES}, {TABLE} {tile_rows} WHERE mz_max >= 5 AND mz_min <= 60 AND rt_max >= 3600 AND rt_min <= 2000000",
        "open_box": f"WITH {P} SELECT {OUT} FROM p WHERE mz <= 20",
        "project_axes": f"WITH {P} SELECT mz, CAST(rt AS DOUBLE) AS rt, intensity FROM p",
        "points_by_ids": f"WITH {P}, {ORDER_IDS} SELECT {OUT} FROM p JOIN ids USING (point_id)",
        "unknown_ids": f"WITH {P}, {ORDER_IDS} SELECT DISTINCT point_id FROM ids WHERE point_id NOT IN (SELECT point_id FROM p)",
        "tile_members": f"WITH {TILES}, {LEAVES} SELECT {OUT} FROM t JOIN leaves USING (leaf_depth, tile_id) WHERE leaves.mz_max >= 5 AND leaves.mz_min <= 60 AND leaves.rt_max >= 3600 AND leaves.rt_min <= 2000000",
        "tile_children": f"WITH {TILES}, {TABLE} SELECT c.* FROM tiles c JOIN tiles a ON c.depth = 2 AND a.depth = 1 AND c.parent_id = a.tile_id AND a.mz_max > 30",
        "subtree": f"WITH {TILES}, {TABLE} {tile_rows} WHERE (depth = 1 AND tile_id = 1) OR (depth = 2 AND parent_id = 1)",
        "viewport_tiles": f"WITH {TILES}, {LEAVES}, {ASKED} SELECT viewport_id, leaf_depth AS depth, tile_id FROM leaves JOIN q ON mz_max >= q1 AND mz_min <= q2 AND rt_max >= q3 AND rt_min <= q4",
        "viewport_points": f"WITH {P}, {ASKED} SELECT viewport_id, point_id FROM p JOIN q ON mz BETWEEN q1 AND q2 AND rt BETWEEN q3 AND q4",
        "dataset_summary": f"WITH {P} SELECT run_id, {RANGES}, count(*) AS point_count FROM p GROUP BY run_id",
        "count_points": f"WITH {P}, {SPECTRA} SELECT run_id, CAST(sum(n_strong) AS BIGINT) AS n_points FROM s WHERE ms_level IN (0, 1) GROUP BY run_id",
        "tile_bounds": f"WITH {TILES}, {LEAVES} SELECT 'events' AS run_id, leaves.* FROM leaves",
        "tile_bounds_rollup": f"WITH {TILES}, {TABLE} {tile_rows}",
        "axis_sums": f"WITH {P} SELECT run_id, sum(round(mz * 100)) AS mz_sum, sum(CAST(rt AS DOUBLE)) AS rt_sum, sum(intensity) AS int_sum FROM p GROUP BY run_id",
        "points_per_level": f"WITH {LEVELS} SELECT run_id, lod AS depth, CAST(sum(count(*)) OVER (PARTITION BY run_id ORDER BY lod) AS BIGINT) AS n_points FROM l WHERE {IN_BOX} GROUP BY run_id, lod",
        "tile_point_ids": f"WITH {TILES} SELECT leaf_depth, tile_id, string_agg(CAST(point_id AS VARCHAR), ',' ORDER BY point_id) AS point_ids FROM t GROUP BY leaf_depth, tile_id",
        "tree_shape": f"WITH {TILES}, {TABLE}, k AS (SELECT depth - 1 AS depth, parent_id AS tile_id, count(*) AS f FROM tiles WHERE depth > 0 GROUP BY ALL) SELECT run_id, tiles.depth, count(*) AS n_tiles, CAST(sum(CAST(is_leaf AS BIGINT)) AS BIGINT) AS n_leaves, coalesce(max(f), 0) AS max_fan_out FROM tiles LEFT JOIN k USING (depth, tile_id) GROUP BY run_id, tiles.depth",
        "distinct_points": f"WITH {P} SELECT run_id, min(point_id) AS point_id, meta1, floor(mz) AS mz, CAST(0 AS DOUBLE) AS rt, intensity FROM p GROUP BY run_id, meta1, floor(mz), intensity",
        "union_points": f"WITH {P} SELECT {OUT} FROM p WHERE mz <= 5 UNION ALL SELECT {OUT} FROM p WHERE intensity >= 90",
        "assign_point_ids": f"WITH {ITEMS} SELECT {OUT} FROM items",
        "chunk_split": f"WITH {P} SELECT point_id, (row_number() OVER (ORDER BY mz, point_id) - 1) // CAST(ceil((SELECT count(*) FROM p) / 7.0) AS BIGINT) AS chunk FROM p",
        "fixed_chunks": f"WITH {P}, x AS (SELECT *, (row_number() OVER (ORDER BY rt, point_id) - 1) // 300 AS chunk FROM p) SELECT chunk, count(*) AS n, min(point_id) AS first_id, max(mz) AS mz_max FROM x GROUP BY chunk",
        "tile": f"WITH {TILES} SELECT point_id, leaf_depth, tile_id FROM t",
        "tile_sketched": f"WITH {TILES} SELECT point_id, leaf_depth, tile_id FROM t",
        "tree_config": f"WITH {P}, {CFG} SELECT 'events' AS run_id, leaves, k AS fan_out FROM cfg",
        "sort_points": f"WITH {P} SELECT {OUT} FROM p ORDER BY mz, point_id",
        "limit_points": f"WITH {P} SELECT {OUT} FROM p ORDER BY rt, point_id LIMIT 100",
        "top_intensity": first(N, "intensity DESC, point_id DESC"),
        "top_intensity_by_group": first(5, "intensity DESC, point_id DESC", "run_id, meta1"),
        "stride_uniform": f"WITH {P}, x AS (SELECT *, row_number() OVER (ORDER BY point_id) - 1 AS idx, greatest(1, count(*) OVER () // {N}) AS step, count(*) OVER () AS n FROM p) SELECT {OUT} FROM x WHERE n <= {N} OR (idx % step = 0 AND idx // step < {N})",
        "stride_weighted": f"WITH {P}, {weighted('p', 'run_id', N, OUT)} SELECT * FROM picked",
        "stride_weighted_by_group": f"WITH {P}, {weighted('p', 'meta1', 20, OUT)} SELECT * FROM picked",
        "stride_weighted_items": f"WITH {ITEMS}, {weighted('items', 'run_id', 5000, OUT)} SELECT run_id, count(*) AS n, CAST(sum(point_id) AS BIGINT) AS id_sum, sum(intensity) AS int_sum FROM picked GROUP BY run_id",
        "sample_uniform": first(N, f"{uniform('point_id')}, point_id"),
        "sample_weighted": f"""WITH {P}, x AS (SELECT *, intensity * {N} / sum(intensity) OVER (PARTITION BY run_id) / 2 AS half FROM p), y AS (SELECT *, CAST(unnest(range(0, 4)) AS INTEGER) AS pass FROM x)
SELECT pass, point_id FROM y WHERE {uniform("pass || ':' || point_id")} <= half QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY pass, point_id) <= {N}""",
        "sample_reservoir": first(N, f"ln({uniform('point_id')}) / intensity DESC, point_id"),
        "summarize": first(N, "intensity DESC, point_id DESC"),
        "summarize_custom": first(3, "intensity, point_id", "run_id, meta1"),
        "round_bounds_outward": f"WITH {P} SELECT run_id, floor(min(mz) * 1000) / 1000 AS mz_min, ceil(max(mz) * 1000) / 1000 AS mz_max, floor(CAST(min(rt) AS DOUBLE) * 1000) / 1000 AS rt_min, ceil(CAST(max(rt) AS DOUBLE) * 1000) / 1000 AS rt_max FROM p GROUP BY run_id",
    }
