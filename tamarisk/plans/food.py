"""Food-insecurity phases: key repair, outer joins to areas, phase and period maps, and long tables of totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions import stats, text
from tamarisk.operators import relational
from tamarisk.plans import inputs
from tamarisk.plans.inputs import ctes
from tamarisk.sources import tables

# Areas whose names differ between phase tables and boundaries.
REPAIRS = {
    "Zambia_Muchiga": "Zambia_Northern",
    "Mozambique_Zambezia": "Mozambique_Zambézia",
    "Madagascar_Vatovavy": "Madagascar_Fianarantsoa",
    "Madagascar_Fitovivany": "Madagascar_Fianarantsoa",
    "Madagascar_Androy": "Madagascar_Toliara",
    "Madagascar_Anosy": "Madagascar_Toliara",
    "Madagascar_Atsimo Andrefana": "Madagascar_Toliara",
    "Madagascar_Atsimo Atsinanana": "Madagascar_Fianarantsoa",
}
# Choices of the phase menu and the measures they show; the last has no rows under its strict name.
MEASURES = {"Phase 3+": "phase3plus_num", "Phase 3": "phase3_num_t", "Phase 4+": "phase4plus_num", "Phase 4": "phase4_num_t", "Phase 5": "phase5_num"}

# Countries that the boundary file has under an older name.
RENAMED = {"Swaziland": "Eswatini"}

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    def put(f):
        QUERIES[f"q_{f.__name__}"], ORACLE[f"q_{f.__name__}"] = f, sql
        return f

    return put


def repaired(phases: DataFrame, areas: DataFrame, repairs: dict[str, str] = REPAIRS) -> DataFrame:
    """Adds admin_fixed: the key where an area has it, its repair where one is known, '' else."""
    out = relational.flag_in(phases, "admin_id", areas, "admin_id", "__known")
    fixed = F.when(F.col("__known"), F.col("admin_id"))
    for wrong, right in repairs.items():
        fixed = fixed.when(F.col("admin_id") == wrong, right)
    return out.withColumn("admin_fixed", fixed.otherwise("")).drop("__known")


def area_keys(areas: DataFrame, country: str, area: str, renamed: dict[str, str] = RENAMED) -> DataFrame:
    """Areas with admin_id, the country's present name and the area's, so that phase rows meet them."""
    return relational.unite(areas.withColumn(country, text.recode(F.col(country), renamed)), "admin_id", [country, area])


def phase_title(phase: str, period: F.Column) -> F.Column:
    """The heading of a phase map; the period in title case."""
    return F.concat(F.lit(f"Acute Food Insecurity IPC Phase {phase} ("), text.title_case(period), F.lit(")"))


def country_totals(areas: DataFrame, totals: DataFrame, key: str = "iso3") -> DataFrame:
    """Countries and their totals by the key both have, either side's rows kept; the key comes once."""
    return relational.merge_outer(areas, totals, key, key)


def with_percent(phases: DataFrame) -> DataFrame:
    return phases.withColumn("percent_pop", stats.ratio(stats.as_number(F.col("number")), stats.as_number(F.col("total_country_population"))) * 100)


def phase_map(joined: DataFrame, phase: str, period: str, keep_unmatched: bool = False) -> DataFrame:
    """Rows of a phase and a period; rows without a period count for all. Adds number_t.

    Areas without phase rows are left out as the maps leave them out, unless `keep_unmatched`.
    """
    of_phase = F.col("phase") == phase
    if keep_unmatched:
        of_phase = of_phase | F.col("phase").isNull()
    of_period = (F.col("validity_period") == period) | F.col("validity_period").isNull()
    return joined.where(of_phase & of_period).withColumn("number_t", stats.as_number(F.col("number")))


def phase_totals(df: DataFrame) -> DataFrame:
    """Adds phase*_num_t and the sums from phase 3 and from phase 4 on, null where all parts are, and makes them long."""
    parts = ["phase3_num", "phase4_num", "phase5_num"]
    out = df.withColumns({f"{c}_t": F.col(c) for c in parts})
    out = out.withColumns({"phase3plus_num": relational.row_sum(parts), "phase4plus_num": relational.row_sum(parts[1:])})
    return relational.longer(out, ["phase3_num_t", "phase4_num_t", "phase5_num_t", "phase3plus_num", "phase4plus_num"], "labels", "vals")


def shown_measure(long: DataFrame, choice: str, strict: bool = True) -> DataFrame:
    """Rows of a menu choice. As run, phase 5 keeps to the menu's name, which no row has; without `strict` its rows are found."""
    name = MEASURES[choice]
    return long.where(F.col("labels").isin(name) if strict else F.col("labels").isin(name, f"{name}_t"))


# ---- queries -----------------------------------------------------------------------------------------------------

_FIX = {"BRAZIL_BUILDING": "BRAZIL_MACHINERY", "CHINA_FURNITURE": "CHINA_AUTOMOBILE"}
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_AREAS = f"areas AS (SELECT n_name || '_' || s AS admin_id, n_name AS country_shape, s AS admin FROM nation, (VALUES {', '.join(f'({chr(39)}{s}{chr(39)}, {i})' for i, s in enumerate(_SEGMENTS))}) t(s, i) WHERE (n_nationkey + i) % 3 <> 0)"
_IPC = f"""WITH {ctes('phases')}, {_AREAS}, ipc AS (
  SELECT p.*, country || '_' || coalesce(level_1, 'NA') AS admin_id, number / nullif(total_country_population, 0) * 100 AS percent_pop FROM phases p WHERE "from" >= DATE '1996-01-01'
), fixed AS (
  SELECT *, CASE WHEN EXISTS (SELECT 1 FROM areas a WHERE a.admin_id = ipc.admin_id) THEN admin_id {' '.join(f"WHEN admin_id = '{a}' THEN '{b}'" for a, b in _FIX.items())} ELSE '' END AS admin_fixed FROM ipc
), joined AS (
  SELECT coalesce(a.admin_id, f.admin_fixed) AS admin_id, a.country_shape, a.admin, f.admin_id AS admin_id_y, f.country, f."from", f.phase, f.validity_period, f.number, f.percent_pop FROM areas a FULL JOIN fixed f ON a.admin_id IS NOT DISTINCT FROM f.admin_fixed
)"""


def _areas(spark: SparkSession, d: str) -> DataFrame:
    n = inputs.table(spark, d, "nation")
    each = n.select("n_nationkey", F.col("n_name").alias("country_shape"), F.posexplode(F.array(*map(F.lit, _SEGMENTS))).alias("i", "admin"))
    return relational.unite(each.where((F.col("n_nationkey") + F.col("i")) % 3 != 0), "admin_id", ["country_shape", "admin"]).select("admin_id", "country_shape", "admin")


def _ipc(spark: SparkSession, d: str) -> DataFrame:
    recent = inputs.phases(spark, d).where(F.col("from") >= F.lit("1996-01-01").cast("date"))
    return with_percent(repaired(relational.unite(recent, "admin_id", ["country", "level_1"]), _areas(spark, d), _FIX))


def _joined(spark: SparkSession, d: str) -> DataFrame:
    return relational.merge_outer(_areas(spark, d), _ipc(spark, d), "admin_id", "admin_fixed")


@query(f'{_IPC} SELECT country, level_1, admin_id, admin_fixed, count(*) AS n, round(avg(percent_pop), 4) AS percent_pop FROM fixed GROUP BY 1, 2, 3, 4')
def ipc_key_repair(spark: SparkSession, d: str) -> DataFrame:
    return _ipc(spark, d).groupBy("country", "level_1", "admin_id", "admin_fixed").agg(F.count("*").alias("n"), F.round(F.avg("percent_pop"), 4).alias("percent_pop"))


@query(f'{_IPC} SELECT admin_id, country_shape, admin, admin_id_y, country, "from", phase, validity_period, round(number, 4) AS number FROM joined')
def ipc_full_outer(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d).select("admin_id", "country_shape", "admin", "admin_id_y", "country", "from", "phase", "validity_period", F.round(stats.as_number(F.col("number")), 4).alias("number"))


@query(f"{_IPC} SELECT admin_id, country, phase, validity_period, round(number, 4) AS number_t FROM joined WHERE phase = '1-URGENT' AND (validity_period = 'F' OR validity_period IS NULL)")
def ipc_phase_abs(spark: SparkSession, d: str) -> DataFrame:
    return phase_map(_joined(spark, d), "1-URGENT", "F").select("admin_id", "country", "phase", "validity_period", F.round("number_t", 4).alias("number_t"))


@query(f"{_IPC} SELECT admin_id, country, phase, validity_period, round(percent_pop, 4) AS percent_pop FROM joined WHERE (phase = '2-HIGH' OR phase IS NULL) AND (validity_period = 'O' OR validity_period IS NULL)")
def ipc_phase_pct(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the country's population, areas without rows kept."""
    return phase_map(_joined(spark, d), "2-HIGH", "O", keep_unmatched=True).select("admin_id", "country", "phase", "validity_period", F.round("percent_pop", 4).alias("percent_pop"))


_WIDE = f"""WITH {ctes('phases')}, wide AS (
  SELECT country, "from", CAST(sum(CASE WHEN phase = '3-MEDIUM' THEN CAST(number AS DECIMAL(18,2)) END) AS DOUBLE) AS phase3_num, CAST(sum(CASE WHEN phase = '4-NOT SPECIFIED' THEN CAST(number AS DECIMAL(18,2)) END) AS DOUBLE) AS phase4_num,
    CAST(sum(CASE WHEN phase = '5-LOW' THEN CAST(number AS DECIMAL(18,2)) END) AS DOUBLE) AS phase5_num FROM phases WHERE "from" < DATE '1996-01-01' GROUP BY 1, 2
), t AS (SELECT *, phase3_num AS phase3_num_t, phase4_num AS phase4_num_t, phase5_num AS phase5_num_t,
  CASE WHEN coalesce(phase3_num, phase4_num, phase5_num) IS NOT NULL THEN coalesce(phase3_num, 0) + coalesce(phase4_num, 0) + coalesce(phase5_num, 0) END AS phase3plus_num,
  CASE WHEN coalesce(phase4_num, phase5_num) IS NOT NULL THEN coalesce(phase4_num, 0) + coalesce(phase5_num, 0) END AS phase4plus_num FROM wide
), long AS (SELECT country, "from", labels, round(vals, 4) AS vals FROM t UNPIVOT INCLUDE NULLS (vals FOR labels IN (phase3_num_t, phase4_num_t, phase5_num_t, phase3plus_num, phase4plus_num)))"""


def _long(spark: SparkSession, d: str) -> DataFrame:
    p = inputs.phases(spark, d).where(F.col("from") < F.lit("1996-01-01").cast("date"))
    part = lambda phase: F.sum(F.when(F.col("phase") == phase, F.col("number").cast("decimal(18,2)"))).cast("double")
    wide = p.groupBy("country", "from").agg(part("3-MEDIUM").alias("phase3_num"), part("4-NOT SPECIFIED").alias("phase4_num"), part("5-LOW").alias("phase5_num"))
    return phase_totals(wide).select("country", "from", "labels", F.round("vals", 4).alias("vals"))


@query(f'{_WIDE} SELECT country, "from", labels, vals FROM long')
def ipc_rowsums_long(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d)


@query(f"{_WIDE} SELECT country, \"from\", labels, vals FROM long WHERE labels = 'phase5_num_t'")
def ipc_menu_choice(spark: SparkSession, d: str) -> DataFrame:
    return shown_measure(_long(spark, d), "Phase 5", strict=False)


_CODES = ("AO", "SZ", "LS", "MG", "MW", "MZ", "NA", "MW", "MZ", "ZA", "ZM", "ZW", "XX")


@query(f"""WITH c AS (SELECT n_nationkey, [{', '.join(f"'{c}'" for c in _CODES)}][n_nationkey % {len(_CODES)} + 1] AS iso2 FROM nation), codes AS (SELECT * FROM (VALUES {', '.join(str(r) for r in tables.COUNTRIES)}) t(iso2, iso3, country_name))
SELECT n_nationkey, iso2, iso3, country_name FROM c LEFT JOIN codes USING (iso2)""")
def country_lookup(spark: SparkSession, d: str) -> DataFrame:
    codes = tables.country_codes(spark)
    given = inputs.table(spark, d, "nation").select("n_nationkey", F.get(F.array(*map(F.lit, _CODES)), F.col("n_nationkey") % len(_CODES)).alias("iso2"))
    named = relational.lookup(given, "iso2", codes, "iso2", "iso3", "iso3")
    return relational.lookup(named, "iso3", codes, "iso3", "country_name", "country_name")


@query(f"""SELECT n_nationkey, country, level, layer FROM nation JOIN (VALUES {', '.join(str((c, f'adm{i}', n)) for c, names in tables.LAYERS.items() for i, n in enumerate(names))}) t(country, level, layer) ON upper(country) = n_name""")
def layer_names(spark: SparkSession, d: str) -> DataFrame:
    """Boundary layers of the nations that have some."""
    n, layers = inputs.table(spark, d, "nation"), tables.layer_names(spark)
    return n.join(layers, F.upper("country") == F.col("n_name")).select("n_nationkey", "country", "level", "layer")


@query(f"""WITH {ctes('phases')}, c AS (SELECT n_nationkey, ['AGO', 'SWZ', 'LSO', 'ZZZ', NULL][n_nationkey % 5 + 1] AS iso3, n_name FROM nation WHERE n_nationkey < 9
), t AS (SELECT CASE phase WHEN '1-URGENT' THEN 'AGO' WHEN '2-HIGH' THEN 'SWZ' WHEN '3-MEDIUM' THEN 'MOZ' WHEN '5-LOW' THEN NULL ELSE 'LSO' END AS iso3, count(*) AS n FROM phases GROUP BY 1)
SELECT coalesce(c.iso3, t.iso3) AS iso3, n_nationkey, n_name, n FROM c FULL JOIN t ON c.iso3 IS NOT DISTINCT FROM t.iso3""")
def ipc_same_key_outer(spark: SparkSession, d: str) -> DataFrame:
    """Countries and totals joined in full on the one key they share; null keys meet."""
    codes = F.array(*[F.lit(c) for c in ("AGO", "SWZ", "LSO", "ZZZ")], F.lit(None).cast("string"))
    areas = inputs.table(spark, d, "nation").where("n_nationkey < 9").select("n_nationkey", F.get(codes, F.col("n_nationkey") % 5).alias("iso3"), "n_name")
    iso3 = F.when(F.col("phase") == "1-URGENT", "AGO").when(F.col("phase") == "2-HIGH", "SWZ").when(F.col("phase") == "3-MEDIUM", "MOZ").when(F.col("phase") != "5-LOW", "LSO")
    return country_totals(areas, inputs.phases(spark, d).groupBy(iso3.alias("iso3")).agg(F.count("*").alias("n")))


@query(f"""WITH {ctes('phases')}, a AS (SELECT CASE WHEN n_name = 'CHINA' THEN 'KENYA' ELSE n_name END AS country, s AS admin FROM nation, (VALUES {', '.join(f"('{s}')" for s in _SEGMENTS)}) t(s) WHERE n_name <> 'KENYA'
), k AS (SELECT country || '_' || admin AS admin_id FROM a), f AS (SELECT country || '_' || level_1 AS admin_id, validity_period, count(*) AS n FROM phases GROUP BY 1, 2)
SELECT admin_id, 'Acute Food Insecurity IPC Phase 3+ (' || CASE validity_period WHEN 'F' THEN 'First Projection' WHEN 'O' THEN 'Current' END || ')' AS title, n FROM f SEMI JOIN k USING (admin_id)""")
def ipc_renamed_countries(spark: SparkSession, d: str) -> DataFrame:
    """Phase rows that meet areas once a country's older name is recoded, under the heading their map has."""
    n = inputs.table(spark, d, "nation").where("n_name <> 'KENYA'").select(F.col("n_name").alias("country"), F.explode(F.array(*map(F.lit, _SEGMENTS))).alias("admin"))
    areas = area_keys(n, "country", "admin", {"CHINA": "KENYA"}).select("admin_id").distinct()
    rows = relational.unite(inputs.phases(spark, d), "admin_id", ["country", "level_1"]).groupBy("admin_id", "validity_period").agg(F.count("*").alias("n"))
    period = F.when(F.col("validity_period") == "F", "FIRST projection").when(F.col("validity_period") == "O", "current")
    return rows.join(areas, "admin_id", "left_semi").select("admin_id", phase_title("3+", period).alias("title"), "n")
