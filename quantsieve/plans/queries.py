"""Registry of the screening queries, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantsieve.functions.metrics import METRICS, with_metrics
from quantsieve.operators import history, parity, quality, rank_index, ranking, scoring, screen
from quantsieve.plans import oracle as o
from quantsieve.sources import tables, uploads
from quantsieve.sources.schema import CATEGORIES, CATEGORY_OF, DISPLAY, FACTOR_NAMES, FACTORS, HEADERS, IDENTITY, INVERTED, METRIC_OF, default_config
from quantsieve.sources.shared import new_path
from quantsieve.sources.universe import read_companies, read_panel
from quantsieve.streaming import refresh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
RAW_NUMBERS = [c for c in HEADERS.values() if c not in IDENTITY]
SHOWN = ", ".join(DISPLAY)


def register(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def measured(spark: SparkSession, sf_dir: str, day: str = "2001-08-01") -> DataFrame:
    return with_metrics(read_companies(spark, sf_dir, day))


def scored(spark: SparkSession, sf_dir: str, keep: Sequence[str] = DISPLAY, **options) -> DataFrame:
    """The scored universe with its columns of keep."""
    metrics = measured(spark, sf_dir)
    return scoring.scored_universe(metrics, keep=[c for c in keep if c in metrics.columns], **options)


# --- metrics -------------------------------------------------------------------------------------------


def _metric(name: str) -> None:
    @register(f"metric_{name}", f"SELECT _row_id, ticker, {name} FROM ({o.metrics()})")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return measured(spark, sf_dir).select("_row_id", "ticker", name)


for _name in METRICS:
    _metric(_name)


@register("transform_all", f"SELECT _row_id, {', '.join([*HEADERS.values(), *METRICS])} FROM ({o.metrics()})")
def transform_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("_row_id", *HEADERS.values(), *METRICS)


# --- ranking and scoring -------------------------------------------------------------------------------


def _factor(name: str, metric: str, inverted: bool, default: float) -> None:
    @register(f"factor_{name.removesuffix('_factor')}_factor", f"SELECT _row_id, ticker, {o.rank(metric, inverted, default)} AS {name} FROM ({o.metrics()})")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scoring.factor_scores(measured(spark, sf_dir), factors=[name], keep=["ticker"]).select("_row_id", "ticker", name)


for _f in FACTORS:
    _factor(*_f[:4])


def _ranked(spark: SparkSession, sf_dir: str, column: Column, inverted: bool, default: float) -> DataFrame:
    df = measured(spark, sf_dir).select("_row_id", column.alias("v"))
    return ranking.rank_factors(df, {"score": "v"}, {"score": inverted}, {"score": default}).select("_row_id", "score")


@register("rank_straight", f"SELECT _row_id, {o.rank('ps_diff', False, 0.5)} AS score FROM ({o.metrics()})")
def rank_straight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, F.col("ps_diff"), False, 0.5)


@register("rank_inverted", f"SELECT _row_id, {o.rank('dilution_p3y', True, 0.0)} AS score FROM ({o.metrics()})")
def rank_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, F.col("dilution_p3y"), True, 0.0)


@register("rank_all_null", "SELECT p_partkey AS _row_id, CAST(0.5 AS DOUBLE) AS score FROM part")
def rank_all_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, F.col("perf_1w"), False, 0.5)


@register("percentrank_inc", f"WITH m AS MATERIALIZED ({o.metrics()}) SELECT _row_id, factor, v, CASE WHEN count(*) OVER (PARTITION BY factor) = 1 THEN CAST(1 AS DOUBLE) ELSE (rank() OVER (PARTITION BY factor ORDER BY v) - 1) / CAST(count(*) OVER (PARTITION BY factor) - 1 AS DOUBLE) END AS p FROM (" + " UNION ALL ".join(f"SELECT _row_id, '{f[0]}' AS factor, {f[1]} AS v FROM m WHERE {f[1]} IS NOT NULL" for f in FACTORS) + ")")
def percentrank_inc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for one large universe: value buckets."""
    rows = tables.staged(measured(spark, sf_dir).select("_row_id", *dict.fromkeys(f[1] for f in FACTORS)), "metrics")
    return ranking.rank_table(rows, {f[0]: f[1] for f in FACTORS}, "_row_id", large=0)


@register("factor_scores", f"SELECT _row_id, ticker, {', '.join(FACTOR_NAMES)} FROM ({o.scored()})")
def factor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.factor_scores(measured(spark, sf_dir), keep=["ticker"])


@register("overall_score", f"SELECT _row_id, ticker, overall_score FROM ({o.scored()})")
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, ["ticker"]).select("_row_id", "ticker", "overall_score")


@register("mscore_flag", f"SELECT _row_id, ticker, mscore, coalesce(mscore > CAST(-2.22 AS DOUBLE), FALSE) AS mscore_flag FROM ({o.metrics()})")
def mscore_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("_row_id", "ticker", "mscore", scoring.mscore_flag().alias("mscore_flag"))


@register("scored_universe", f"SELECT _row_id, {', '.join([*HEADERS.values(), *METRICS, *FACTOR_NAMES])}, overall_score, mscore_flag FROM ({o.scored()})")
def scored_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, [*HEADERS.values(), *METRICS]).select("_row_id", *HEADERS.values(), *METRICS, *FACTOR_NAMES, "overall_score", "mscore_flag")


SCENARIOS = {name: {f: w * (2.0 if CATEGORY_OF[f] == name else 0.5) for f, w in default_config()["weights"].items()} for name in CATEGORIES}


@register("overall_score_scenarios", f"WITH sc AS MATERIALIZED ({o.scored()}) " + " UNION ALL ".join(f"SELECT '{name}' AS scenario, _row_id, ticker, {o.overall(weights)} AS overall_score FROM sc" for name, weights in SCENARIOS.items()))
def overall_score_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(name, *[weights[f] for f in FACTOR_NAMES]) for name, weights in SCENARIOS.items()]
    sides = spark.createDataFrame(rows, "scenario string, " + ", ".join(f"{f} double" for f in FACTOR_NAMES))
    return scoring.reweight(factor_scores(spark, sf_dir), sides).select("scenario", "_row_id", "ticker", "overall_score")


def _weighted(c: str) -> str:
    return " + ".join(f"CAST({default_config()['weights'][f]} AS DOUBLE) * {f}" for f in FACTOR_NAMES if CATEGORY_OF[f] == c)


@register("config_weight_check", f"WITH sc AS MATERIALIZED ({o.scored()}) " + " UNION ALL ".join(f"SELECT '{c}' AS category, CAST({sum(round(default_config()['weights'][f] * 10**6) for f in FACTOR_NAMES if CATEGORY_OF[f] == c) / 10**6} AS DOUBLE) AS total_weight, TRUE AS ok, min({_weighted(c)}) AS min_score, max({_weighted(c)}) AS max_score FROM sc" for c in CATEGORIES))
def config_weight_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each category's total weight, and the least and largest weighted score that the universe reaches in it."""
    weights = default_config()["weights"]
    scores = factor_scores(spark, sf_dir)
    parts = [F.struct(F.lit(c).alias("category"), sum((F.lit(weights[f]) * F.col(f) for f in FACTOR_NAMES if CATEGORY_OF[f] == c and f != _first(c)), start=F.lit(weights[_first(c)]) * F.col(_first(c))).alias("score")) for c in CATEGORIES]
    reached = scores.select(F.explode(F.array(*parts)).alias("x")).groupBy("x.category").agg(F.min("x.score").alias("min_score"), F.max("x.score").alias("max_score"))
    return scoring.weight_check(spark).join(reached, "category").select("category", "total_weight", "ok", "min_score", "max_score")


def _first(category: str) -> str:
    return next(f for f in FACTOR_NAMES if CATEGORY_OF[f] == category)


@register("sector_relative_scores", f"SELECT _row_id, ticker, sector, {', '.join(FACTOR_NAMES)}, overall_score FROM ({o.scored(keys='sector')})")
def sector_relative_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, ["ticker"], universe_keys=["sector"]).select("_row_id", "ticker", "sector", *FACTOR_NAMES, "overall_score")


# --- screen --------------------------------------------------------------------------------------------


@register("screen_table", f"SELECT {SHOWN} FROM ({o.scored()})")
def screen_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.display(screen.ordered(scored(spark, sf_dir)))


@register("screen_topk", f"SELECT {SHOWN} FROM ({o.scored()}) ORDER BY overall_score DESC NULLS LAST, ticker, _row_id LIMIT 20")
def screen_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.display(screen.top(scored(spark, sf_dir), 20))


@register("screen_topk_per_sector", f"SELECT {SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY overall_score DESC NULLS LAST, ticker, _row_id) AS rn FROM ({o.scored()})) WHERE rn <= 3")
def screen_topk_per_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.display(screen.top(scored(spark, sf_dir), 3, ["sector"]))


SECTORS, INDUSTRIES, CAPS, SCORES = ["ECONOMY", "PROMO"], ["Brand#11", "Brand#23", "Brand#55"], (5_000.0, 40_000.0), (2.5, 3.5)


def _quoted(xs: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def _filter(name: str, where: str, **given) -> None:
    @register(name, f"SELECT {SHOWN} FROM ({o.scored()}) WHERE {where}")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return screen.display(screen.filtered(scored(spark, sf_dir), **given))


_filter("screen_filter_sector", f"sector IN ({_quoted(SECTORS)})", sectors=SECTORS)
_filter("screen_filter_industry", f"industry IN ({_quoted(INDUSTRIES)})", industries=INDUSTRIES)
_filter("screen_filter_mcap", "market_cap BETWEEN 5000 AND 40000", market_cap=CAPS)
_filter("screen_filter_score", "overall_score BETWEEN 2.5 AND 3.5", score=SCORES)


@register("screen_count", f"SELECT count(*) AS n FROM ({o.scored()}) WHERE sector IN ({_quoted(SECTORS)}) AND market_cap BETWEEN 5000 AND 40000 AND overall_score BETWEEN 2.5 AND 3.5")
def screen_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.filtered(scored(spark, sf_dir), sectors=SECTORS, market_cap=CAPS, score=SCORES).agg(F.count(F.lit(1)).alias("n"))


@register("screen_bounds", f"SELECT min(market_cap) AS min_market_cap, max(market_cap) AS max_market_cap, min(overall_score) AS min_overall_score, max(overall_score) AS max_overall_score FROM ({o.scored()})")
def screen_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed as the scored stage is written."""
    return quality.save_profiled(scored(spark, sf_dir, ["market_cap"]), new_path(spark, "scored")).bounds_table(spark)


@register("screen_facets_sector", "SELECT DISTINCT p_type AS sector FROM part WHERE p_type IS NOT NULL")
def screen_facets_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.facet(read_companies(spark, sf_dir), "sector")


@register("screen_facets_industry", f"SELECT DISTINCT p_brand AS industry FROM part WHERE p_brand IS NOT NULL AND p_type IN ({_quoted(SECTORS)})")
def screen_facets_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.facet(read_companies(spark, sf_dir), "industry", SECTORS)


@register("screen_facets_ticker", "SELECT DISTINCT 'P' || p_partkey AS ticker FROM part")
def screen_facets_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.facet(read_companies(spark, sf_dir), "ticker")


@register("screen_export", f"SELECT {SHOWN} FROM ({o.scored()})")
def screen_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV and read again."""
    screen.export_csv(scored(spark, sf_dir), path := new_path(spark, "export"))
    types = {"market_cap": "double", "overall_score": "double", "mscore_flag": "boolean"} | dict.fromkeys(FACTOR_NAMES, "double")
    return spark.read.option("header", True).schema(", ".join(f"{c} {types.get(c, 'string')}" for c in DISPLAY)).csv(path)


@register("drill_lookup", f"SELECT _row_id, {SHOWN} FROM ({o.scored()}) WHERE ticker = 'P42'")
def drill_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = screen.lookup(scored(spark, sf_dir), "P42")
    return found.select("_row_id", *DISPLAY)


@register("drill_card", f"SELECT ticker, name, sector, industry, market_cap, overall_score, mscore, mscore_flag FROM ({o.scored()})")
def drill_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.card(scored(spark, sf_dir))


@register("drill_chart_rows", f"WITH sc AS MATERIALIZED ({o.scored()}) SELECT * FROM ({o.facts('SELECT * FROM sc', 'ticker')}) WHERE score IS NOT NULL")
def drill_chart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.chart_rows(scored(spark, sf_dir, ["ticker"]))


@register("drill_report", f"WITH sc AS MATERIALIZED ({o.scored()}) " + "SELECT ticker, category, factor_label, category_ordinal, factor_ordinal, coalesce('$' || format('{:,.0f}', round_even(market_cap, 0)), 'N/A') AS market_cap_text, CASE WHEN mscore IS NULL THEN 'N/A' ELSE printf('%.2f', round(mscore, 2)) END AS mscore_text, CASE WHEN score IS NULL THEN 'N/A' ELSE printf('%.3f', round(score, 3)) END AS score_text FROM (" + o.facts("SELECT * FROM sc", "ticker, market_cap, mscore") + ")")
def drill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.report(scored(spark, sf_dir, ["ticker", "market_cap"]))


# --- ingest --------------------------------------------------------------------------------------------


def _messy(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as a vendor would send them: strings with thousands commas, blanks and missing markers, under vendor headers."""
    header = {v: k for k, v in HEADERS.items()}
    odd = F.col("_row_id") % 2 == 1

    numbers = [c for c in columns if c not in IDENTITY]

    def text(s: Column, i: Column) -> Column:
        # Up to three digits take no comma, up to six one; a pattern is sought in the rest alone.
        point = F.instr(s, ".")
        digits = point - F.when(s.startswith("-"), 2).otherwise(1)
        several = F.regexp_replace(s, r"(?<!\.\d{0,30})(?<=\d)(?=(\d{3})+(?:\.|$))", ",")
        s = F.when((point > 0) & (digits <= 3), s).when((point > 0) & (digits <= 6), F.concat(F.substr(s, F.lit(1), point - 4), F.lit(","), F.substr(s, point - 3))).otherwise(several)
        return F.coalesce(F.when(odd, F.concat(F.lit(" "), s, F.lit("\t"))).otherwise(s), F.when(odd | (i == numbers.index("available_loc")), F.lit("#N/A N/A")).otherwise(F.lit("")))

    told = df.select(*[c for c in columns if c in IDENTITY], F.transform(F.array(*[F.col(c).cast("string") for c in numbers]), text).alias("_texts"))
    return told.select(*[(F.col(c) if c in IDENTITY else F.get("_texts", F.lit(numbers.index(c)))).alias(header.get(c, c)) for c in columns])


def _send(df: DataFrame, columns: list[str], path: str) -> str:
    """df as one upload."""
    part = df.withColumn("extra_note", F.concat(F.lit("note "), F.col("_row_id")))
    _messy(part, columns).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _upload(spark: SparkSession, sf_dir: str) -> list[str]:
    """The universe as two uploads with different orders of columns, the second with one column more; their folders."""
    df = tables.staged(read_companies(spark, sf_dir), "companies")
    columns = list(HEADERS.values())
    halves = ((F.col("_row_id") % 3 > 0, columns), (F.col("_row_id") % 3 == 0, [*columns[::-1], "extra_note"]))
    return [_send(df.where(keep), order, new_path(spark, "upload")) for keep, order in halves]


def _clean_raw(names: list[str]) -> str:
    told = ", ".join("coalesce(available_loc, CAST(0 AS DOUBLE)) AS available_loc" if n == "available_loc" else n for n in names)
    return f"SELECT {told} FROM ({o.raw()})"


@register("ingest_multi_file", f"SELECT *, CAST(NULL AS DOUBLE) AS extra_note FROM ({_clean_raw(list(HEADERS.values()))})")
def ingest_multi_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads.ingest(spark, *_upload(spark, sf_dir)).drop("_source_file")


@register("ingest_clean", _clean_raw(["ticker", "sector", "market_cap", "ps_ntm", "revenues_ttm", "net_debt"]))
def ingest_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads.ingest(spark, *_upload(spark, sf_dir)).select("ticker", "sector", "market_cap", "ps_ntm", "revenues_ttm", "net_debt")


@register("ingest_clean_loc", _clean_raw(["ticker", "available_loc"]))
def ingest_clean_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads.ingest(spark, *_upload(spark, sf_dir)).select("ticker", "available_loc")


@register("ingest_clean_numeric", _clean_raw(["ticker", *RAW_NUMBERS]))
def ingest_clean_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads.ingest(spark, *_upload(spark, sf_dir)).select("ticker", *RAW_NUMBERS)


@register("ingest_scan", "SELECT 'P' || p_partkey AS \"Ticker\", p_name AS \"Name\", p_type AS \"Sector\", p_brand AS \"Industry\" FROM part")
def ingest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All uploads as strings, before any cleaning; each header's files are scanned together."""
    united = None
    for files in uploads.by_header(spark, uploads.list_uploads(spark, *_upload(spark, sf_dir))).values():
        part = uploads.scan(spark, files).select("Ticker", "Name", "Sector", "Industry")
        united = part if united is None else united.unionByName(part)
    return united


_LACKING = ["cfo", "ps_3yr_avg"]
_VENDOR = {v: k for k, v in HEADERS.items()}


@register("ingest_missing_columns", " UNION ALL ".join(f"SELECT 'second' AS upload, '{_VENDOR[c]}' AS missing_column, count(*) AS n_rows FROM part WHERE p_partkey % 3 = 1" for c in _LACKING))
def ingest_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that each of three uploads lacks, and the rows that this sets apart."""
    df, folder = tables.staged(read_companies(spark, sf_dir), "companies"), new_path(spark, "uploads")
    columns = list(HEADERS.values())
    orders = {"first": columns, "second": [c for c in columns if c not in _LACKING], "third": columns[::-1]}
    sent = [_send(df.where(F.col("_row_id") % 3 == i), order, f"{folder}/{name}") for i, (name, order) in enumerate(orders.items())]
    found = uploads.missing_report(spark, uploads.list_uploads(spark, *sent))
    upload = F.element_at(F.split("file", "/"), -2)  # one upload is a folder of part files, each with a header
    return found.groupBy(upload.alias("upload"), "missing_column").agg(F.sum(F.col("n_lines") - 1).alias("n_rows"))


@register("refresh_uploads", f"SELECT 'score' AS kind, '2001-08-01' AS as_of, ticker AS subject, overall_score AS value FROM ({o.scored()}) UNION ALL " + " UNION ALL ".join(f"SELECT 'missing_column', '2001-02-01', '{_VENDOR[c]}', NULL" for c in _LACKING))
def refresh_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two waves of uploads, one bad, taken up as they come: the snapshot's scores after the second, and what was set apart."""
    df, folder = tables.staged(read_companies(spark, sf_dir), "companies"), new_path(spark, "refresh")
    columns = list(HEADERS.values())
    third, bad = F.col("_row_id") % 3 == 0, [c for c in columns if c not in _LACKING]
    for wave in ([("2001-08-01-first", ~third, columns), ("2001-02-01-bad", F.lit(True), bad)], [("2001-08-01-second", third, columns[::-1])]):
        for name, keep, order in wave:
            _send(df.where(keep), order, f"{folder}/incoming/{name}")
        refresh.refresh_uploads(spark, *(f"{folder}/{x}" for x in ("incoming", "raw", "scored", "quarantine", "checkpoint"))).awaitTermination()
    scores = tables.load(spark, f"{folder}/scored").select(F.lit("score").alias("kind"), F.col("as_of").cast("string"), F.col("ticker").alias("subject"), F.col("overall_score").alias("value"))
    apart = tables.load(spark, f"{folder}/quarantine").select(F.col("finding").alias("kind"), F.regexp_extract("file", refresh.SNAPSHOT, 1).alias("as_of"), "subject", F.lit(None).cast("double").alias("value")).distinct()
    return scores.unionByName(apart)


@register("rescore_late_rows", f"SELECT _row_id, ticker, {', '.join(FACTOR_NAMES)}, overall_score FROM ({o.scored()})")
def rescore_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from an index of ranks that was built of some companies and to which the others, those with the largest market caps among them, came late."""
    rows, path = tables.staged(measured(spark, sf_dir), "metrics"), new_path(spark, "ranks")
    late = F.col("market_cap") > 60_000
    rank_index.build(path, rows.where(~late), METRIC_OF, ranges=4)
    rank_index.add(path, rows.where(late), METRIC_OF)
    config = default_config()
    return scoring.finished(ranking.join_scores(rows, rank_index.ranks(spark, path), METRIC_OF, INVERTED, config["defaults"]), config).select("_row_id", "ticker", *FACTOR_NAMES, "overall_score")


@register("stage_scored_roundtrip", f"SELECT _row_id, {', '.join([*METRICS, *FACTOR_NAMES])}, overall_score, mscore_flag FROM ({o.scored()})")
def stage_scored_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and scores, each stage written and read again."""
    tables.save(measured(spark, sf_dir), path := new_path(spark, "metrics"))
    tables.save(scoring.scored_universe(tables.load(spark, path)), path := new_path(spark, "scored"))
    return tables.load(spark, path).select("_row_id", *METRICS, *FACTOR_NAMES, "overall_score", "mscore_flag")


@register("stage_snapshots", " UNION ALL ".join(f"SELECT DATE '{day}' AS as_of, _row_id, ticker, market_cap, revenues_ttm FROM ({o.raw(day)})" for day in o.PANEL))
def stage_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated snapshots in one table, each saved on its own without touching the others."""
    path = new_path(spark, "snapshots")
    for day in o.PANEL:
        tables.save(read_companies(spark, sf_dir, day).withColumn("as_of", F.lit(day).cast("date")), path, "as_of")
    return tables.load(spark, path).select("as_of", "_row_id", "ticker", "market_cap", "revenues_ttm")


@register("stage_raw_roundtrip", f"SELECT _row_id, {', '.join(HEADERS.values())} FROM ({o.raw()})")
def stage_raw_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.save(read_companies(spark, sf_dir), path := new_path(spark, "raw"))
    return tables.load(spark, path)


# --- data quality --------------------------------------------------------------------------------------


@register("quality_null_rates", f"WITH m AS MATERIALIZED ({o.metrics()}) SELECT * FROM ({' UNION ALL '.join(f'''SELECT '{c}' AS column_name, CAST(count(*) FILTER ({c} IS NULL) AS DOUBLE) / count(*) AS null_rate FROM m''' for c in [*RAW_NUMBERS, *METRICS])}) WHERE null_rate > 0.1")
def quality_null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted as the metrics' stage is written."""
    return quality.save_profiled(measured(spark, sf_dir), new_path(spark, "metrics"), columns=[*RAW_NUMBERS, *METRICS]).null_rates(spark)


@register("quality_counts", "SELECT count(*) AS n_rows, 121 AS n_columns FROM part")
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.save_profiled(measured(spark, sf_dir), new_path(spark, "metrics")).counts(spark)


@register("quality_missing_columns", " UNION ALL ".join(f"SELECT 'part' AS source, '{c}' AS missing_column, count(*) AS n_rows FROM part" for c in HEADERS.values()))
def quality_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the part table lacks to be an upload, and how many of its rows that concerns."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return quality.missing_columns(part, HEADERS.values(), "part").withColumn("n_rows", F.lit(part.count()))


FIELDS = ["revenues_t3m", "revenues_ttm", "market_cap", "net_debt"]


def _panel_raw(columns: str) -> str:
    return " UNION ALL ".join(f"SELECT DATE '{day}' AS as_of, {columns} FROM ({o.raw(day)})" for day in o.PANEL)


@register("quality_report", f"WITH p AS ({_panel_raw('_row_id, ' + ', '.join(FIELDS))}), kept AS (SELECT * FROM p WHERE revenues_t3m IS NOT NULL OR as_of <> DATE '2001-02-01') " + " UNION ALL ".join(f"SELECT as_of, 'null_rate' AS finding, '{c}' AS subject, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS value FROM kept GROUP BY as_of HAVING value > 0.1" for c in FIELDS) + " UNION ALL SELECT as_of, 'size_change', 'universe', value FROM (SELECT as_of, n / CAST(lag(n) OVER (ORDER BY as_of) AS DOUBLE) - 1 AS value FROM (SELECT as_of, count(*) AS n FROM kept GROUP BY as_of)) WHERE abs(value) > 0.05")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings over three snapshots, of which the second only holds companies with sales in its last quarter."""
    panel = read_panel(spark, sf_dir, o.PANEL)
    kept = panel.where(F.col("revenues_t3m").isNotNull() | (F.col("as_of") != F.lit("2001-02-01").cast("date")))
    return quality.snapshot_report(kept, FIELDS)


_FENCED = [*RAW_NUMBERS, *METRICS]


@register("quality_outliers", f"WITH m AS MATERIALIZED ({o.metrics()}) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, min(low) AS low, min(high) AS high, count(*) FILTER ({c} < low OR {c} > high) AS n_outliers FROM (SELECT {c}, a - CAST(3 AS DOUBLE) * (b - a) AS low, b + CAST(3 AS DOUBLE) * (b - a) AS high FROM m, (SELECT quantile_disc({c}, 0.25) AS a, quantile_disc({c}, 0.75) AS b FROM m)) WHERE {c} IS NOT NULL HAVING count(*) > 0" for c in _FENCED))
def quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.outliers(measured(spark, sf_dir), _FENCED)


_WIDTHS = {"2000-08-01": ["ticker", "market_cap", "revenues_ttm", "cfo"], "2001-02-01": ["ticker", "market_cap", "revenues_ttm", "net_income", "fcf"], "2001-08-01": ["ticker", "market_cap", "revenues_ttm", "net_income", "fcf"]}
_CHANGES = [("2001-02-01", "added", "net_income", None, "double"), ("2001-02-01", "added", "fcf", None, "double"), ("2001-02-01", "lost", "cfo", "double", None), ("2001-02-01", "column_count", "universe", "4", "5"), ("2001-08-01", "type", "market_cap", "double", "string")]


def _literal(x: str | None) -> str:
    return "NULL" if x is None else f"'{x}'"


@register("quality_schema_changes", " UNION ALL ".join(f"SELECT {_literal(a)} AS snapshot, {_literal(b)} AS finding, {_literal(c)} AS subject, {_literal(d)} AS before, {_literal(e)} AS after, count(*) AS n_rows FROM part" for a, b, c, d, e in _CHANGES))
def quality_schema_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between three stored snapshots of different width, and the rows of the later one."""
    path = new_path(spark, "widths")
    for day, columns in _WIDTHS.items():
        df = read_companies(spark, sf_dir, day).select(*columns, F.lit(day).cast("date").alias("as_of"))
        tables.save(df.withColumn("market_cap", F.col("market_cap").cast("string")) if day == "2001-08-01" else df, path, "as_of")
    return quality.schema_findings(quality.schema_history(spark, path))


# --- parity --------------------------------------------------------------------------------------------


def stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df as a stage's table: the two sides of a comparison are both made of it, and read it instead of scoring again."""
    return tables.staged(df, "scored")


def reference(df: DataFrame) -> DataFrame:
    """The external table that parity compares with: scores moved on some keys, some keys gone, some of its own."""
    k = F.col("_row_id")
    moved = [F.lit(None).cast("double").alias(f) if i == 23 else (F.col(f) + F.when(k % (100 if i % 3 != 1 else 10) == 0, 0.01).otherwise(0.0)).alias(f) for i, f in enumerate(FACTOR_NAMES)]
    own = df.where(k % 50 != 7).select(F.concat(F.lit(" "), "ticker", F.lit("\t")).alias("ticker"), *moved, (F.col("overall_score") + F.when(k % 20 == 0, 0.02).otherwise(0.0)).alias("overall_score"), (F.col("mscore") + F.when(k % 2 == 0, 0.0005).otherwise(0.0)).alias("mscore"))
    rest = [*FACTOR_NAMES, "overall_score", "mscore"]
    extra = df.where(k % 40 == 0).select(F.concat(F.lit("X"), "ticker").alias("ticker"), *rest)
    unkeyed = df.where(k % 500 == 1).select(F.lit(None).cast("string").alias("ticker"), *rest)
    return own.union(extra).union(unkeyed)


_WITH = f"WITH sc AS MATERIALIZED ({o.scored()}), ref AS MATERIALIZED ({o.reference('SELECT * FROM sc')})"
_MEAN = "round_even(CAST(sum(CAST(dev AS DECIMAL(38,18))) AS DOUBLE) / nullif(count(*), 0), 6)"


def _within(t: float) -> str:
    return f"round_even(avg(CASE WHEN dev <= CAST({t} AS DOUBLE) THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 2)"


_FACTOR_PARITY = " UNION ALL ".join(
    o.parity(f, f"'{f}' AS factor, count(*) AS n_compared, {_within(0.001)} AS pct_within, round_even(max(dev), 6) AS max_dev, {_MEAN} AS mean_dev, CASE WHEN count(*) = 0 THEN 'NO DATA' WHEN avg(CASE WHEN dev <= CAST(0.001 AS DOUBLE) THEN 100.0 ELSE 0.0 END) >= 95 THEN 'PASS' ELSE 'FAIL' END AS status") for f in FACTOR_NAMES
)


@register("parity_factors", f"{_WITH} {_FACTOR_PARITY}")
def parity_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stored(spark, scored(spark, sf_dir))
    return parity.factor_parity(df, reference(df))


@register("parity_summary", f"{_WITH} SELECT status, count(*) AS n_factors, string_agg(factor, ',' ORDER BY factor) AS factors FROM ({_FACTOR_PARITY}) GROUP BY status")
def parity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.summary(parity_factors(spark, sf_dir))


def _value_sql(column: str, tolerances: list[float]) -> str:
    return o.parity(column, "count(*) AS n_compared, " + ", ".join(f"{_within(t)} AS pct_within_{str(t).replace('.', '_')}" for t in tolerances) + f", round_even(max(dev), 6) AS max_dev, {_MEAN} AS mean_dev")


@register("parity_overall", f"{_WITH} {_value_sql('overall_score', [0.001, 0.01, 0.05])}")
def parity_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stored(spark, scored(spark, sf_dir))
    return parity.value_parity(df, reference(df), "overall_score", [0.001, 0.01, 0.05])


@register("parity_mscore", f"{_WITH} {_value_sql('mscore', [0.001])}")
def parity_mscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stored(spark, scored(spark, sf_dir))
    return parity.value_parity(df, reference(df), "mscore", [0.001])


@register("parity_coverage", f"{_WITH}, a AS (SELECT DISTINCT ticker AS k FROM sc), b AS (SELECT DISTINCT trim(ref_ticker, ' ' || chr(9)) AS k FROM ref WHERE ref_ticker IS NOT NULL) SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS in_both, count(*) FILTER (b.k IS NULL) AS only_computed, count(*) FILTER (a.k IS NULL) AS only_reference FROM a FULL JOIN b ON a.k = b.k")
def parity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stored(spark, scored(spark, sf_dir))
    return parity.coverage(df, reference(df))


# --- history -------------------------------------------------------------------------------------------


def scored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = read_panel(spark, sf_dir, o.PANEL).withColumn("_row_id", F.concat_ws("@", "as_of", "_row_id"))
    return scoring.scored_universe(with_metrics(panel), universe_keys=["as_of"], keep=["ticker", "market_cap", "revenues_ttm"])


_PANEL = o.panel("ticker, market_cap, revenues_ttm, overall_score, " + ", ".join(FACTOR_NAMES))
_W = "OVER (PARTITION BY ticker ORDER BY as_of)"


@register("trend_scores", f"SELECT ticker, as_of, overall_score, lag(overall_score) {_W} AS previous_score, overall_score - lag(overall_score) {_W} AS score_change, CAST(sum(CAST(overall_score AS DECIMAL(28,12))) OVER (PARTITION BY ticker ORDER BY as_of ROWS 2 PRECEDING) AS DOUBLE) / count(*) OVER (PARTITION BY ticker ORDER BY as_of ROWS 2 PRECEDING) AS mean_score FROM ({_PANEL})")
def trend_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.score_trend(scored_panel(spark, sf_dir))


@register("trend_factors", f"WITH p AS MATERIALIZED ({_PANEL}) " + " UNION ALL ".join(f"SELECT ticker, as_of, '{f}' AS factor, {f} AS score, {f} - lag({f}) {_W} AS change FROM p" for f in FACTOR_NAMES))
def trend_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.factor_trend(scored_panel(spark, sf_dir))


@register("backtest_deciles", f"SELECT as_of, decile, count(*) AS n, CAST(sum(CAST(r AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS mean_return FROM (SELECT *, ntile(10) OVER (PARTITION BY as_of ORDER BY overall_score, ticker) AS decile FROM (SELECT as_of, ticker, overall_score, lead(revenues_ttm) {_W} / nullif(revenues_ttm, 0) - 1 AS r FROM ({_PANEL})) WHERE r IS NOT NULL) GROUP BY as_of, decile")
def backtest_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of sales until the next snapshot, by decile of the composite."""
    return history.backtest(scored_panel(spark, sf_dir), "revenues_ttm")
