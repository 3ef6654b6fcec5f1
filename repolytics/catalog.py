"""Every query of the engine with the SQL that gives the same rows.

QUERIES maps a name to a callable (spark, sf_dir); ORACLE_SQL to DuckDB SQL over the same
tables.  The comment above each group names the operators it covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from repolytics.functions import numeric as num, predicates as pred
from repolytics.operators import boundaries, churn, code, cognitive, coupling, decay, gap, ownership, workspace
from repolytics.plans import adapters as facts, health, history, risks
from repolytics.plans.adapters import NOW
from repolytics.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from repolytics.sources import facts as sources
from repolytics.streaming import watch

# SQL fragments -------------------------------------------------------------------------

CF = "cf AS (SELECT o_orderkey AS k, o_orderdate AS ts, o_orderpriority AS author, CAST(l_partkey AS VARCHAR) AS path, CAST(l_quantity AS BIGINT) AS added, CAST(l_linenumber AS BIGINT) AS deleted FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
SF = CF.replace("l_partkey", "l_suppkey")
CHURN = "churn AS (SELECT path, count(*) AS commits, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted, (count(*) + sum(added) + sum(deleted))::BIGINT AS score FROM cf GROUP BY path)"
TOP = "top AS (SELECT * FROM churn ORDER BY score DESC, added DESC, path LIMIT 3)"
AUTHORS = "authors AS (SELECT o_orderpriority AS author, count(*) AS commits FROM orders GROUP BY 1)"
BRANCHES = ", ".join(f"'{w}'" for w in code.BRANCH_WORDS)
FILES = (
    "f AS (SELECT source || '/' || CASE WHEN doc_id % 5 = 0 THEN 'tests/' ELSE '' END || doc_id || '.py' AS path, lang, text, string_split(text, chr(10)) AS l0 FROM documents), "
    "f1 AS (SELECT path, lang, text, CASE WHEN l0[-1] = '' THEN l0[1:len(l0) - 1] ELSE l0 END AS ls FROM f), "
    f"rec AS (SELECT path, lang, len(ls)::BIGINT AS total_lines, len(list_filter(ls, lambda x: regexp_matches(x, '[^ \\t\\r\\f\\x0b]')))::BIGINT AS code_lines, "
    f"(len(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: lower(w)), lambda w: list_contains([{BRANCHES}], w))) + (length(text) - length(replace(text, '&&', ''))) // 2 + (length(text) - length(replace(text, '||', ''))) // 2)::BIGINT AS branch_points, "
    "regexp_matches(path, '/tests/') AS is_test FROM f1), "
    "rec2 AS (SELECT *, (branch_points + 1)::DOUBLE AS complexity, CASE WHEN branch_points + 1 <= 10 THEN 'low' WHEN branch_points + 1 <= 20 THEN 'moderate' WHEN branch_points + 1 <= 50 THEN 'high' ELSE 'very_high' END AS level FROM rec)"
)


def r2(x: str) -> str:
    return f"(trunc(({x}) * 100 + CASE WHEN ({x}) >= 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END) / 100)"


def rh(x: str, digits: int) -> str:
    k = 10**digits
    return f"(round(({x}) * {k}::DOUBLE) / {k}::DOUBLE)"


def c01(x: str) -> str:
    return f"least(greatest(({x}), 0::DOUBLE), 1::DOUBLE)"


def age(ts: str) -> str:
    return f"greatest(0, trunc((epoch_us(TIMESTAMP '{NOW}') - epoch_us({ts})) / 86400000000::DOUBLE))::BIGINT"


def grade_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 90 THEN 'A' WHEN {x} >= 80 THEN 'B' WHEN {x} >= 70 THEN 'C' WHEN {x} >= 60 THEN 'D' ELSE 'F' END"


def severity_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 12 THEN 'critical' WHEN {x} >= 6 THEN 'high' WHEN {x} >= 2 THEN 'medium' ELSE 'low' END"


# SRC-06, AGG-04..07: churn ---------------------------------------------------------------


@query(f"WITH {CF}, {CHURN} SELECT * FROM churn")
def churn_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.churn_by_path(facts.commit_files(spark, sf_dir))


@query(f"WITH {CF}, {CHURN} SELECT * FROM churn ORDER BY score DESC, added DESC, path LIMIT 10")
def churn_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.top_churn(churn_by_path(spark, sf_dir))


CONC = f"SELECT count(*) AS paths, sum(score)::BIGINT AS total, {r2(c01('sum(score::DOUBLE * score) / (sum(score)::DOUBLE * sum(score)::DOUBLE) - 1 / count(*)::DOUBLE') + ' / (1 - 1 / count(*)::DOUBLE)')} AS concentration FROM churn"


@query(f"WITH {CF}, {CHURN} {CONC}")
def churn_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.concentration(churn_by_path(spark, sf_dir))


@query(f"WITH {CF}, {CHURN}, {TOP} SELECT (SELECT sum(score) FROM top)::BIGINT AS top_score, (SELECT sum(added + deleted) FROM churn)::BIGINT AS changed, {r2('(SELECT sum(score) FROM top)::DOUBLE / (SELECT sum(added + deleted) FROM churn)::DOUBLE')} AS rate")
def churn_hotspot_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.hotspot_rate(churn_by_path(spark, sf_dir))


# AGG-08..11: authors and cadence ----------------------------------------------------------


@query(f"WITH {AUTHORS} SELECT * FROM authors")
def author_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.author_counts(facts.commits(spark, sf_dir))


@query(f"WITH {AUTHORS} SELECT max(commits) AS most, sum(commits)::BIGINT AS commits, {r2('max(commits)::DOUBLE / sum(commits)::DOUBLE')} AS top_share FROM authors")
def top_author_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.top_share(author_counts(spark, sf_dir))


@query(f"WITH {AUTHORS} SELECT count(*) FILTER (commits::DOUBLE / (SELECT sum(commits) FROM authors)::DOUBLE >= 0.2::DOUBLE) AS bus_factor FROM authors")
def bus_factor_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.bus_factor(author_counts(spark, sf_dir))


CADENCE = f"SELECT count(*) AS commits, count(*) FILTER (o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY) AS window_commits, least(90, {age('min(o_orderdate)')} + 1)::BIGINT AS span_days, {age('max(o_orderdate)')} AS days_since_commit FROM orders"


@query(f"WITH c AS ({CADENCE}) SELECT commits, window_commits, span_days, {r2('window_commits * 7 / span_days::DOUBLE')} AS commits_per_week, days_since_commit FROM c")
def cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn.cadence(facts.commits(spark, sf_dir), NOW)


# WIN-03/04, AGG-12..17: ownership -----------------------------------------------------------


def owned_sql(unit: str) -> str:
    w = f"CASE WHEN epoch_us(ts) >= epoch_us(TIMESTAMP '{NOW}') THEN 1 ELSE exp((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1000000::DOUBLE / 86400 * (-0.6931471805599453::DOUBLE / 90)) END"
    return (
        f"o1 AS (SELECT {unit} AS unit, author, count(*) AS commits, sum({w}) AS weight, max(ts) AS last_commit FROM cf GROUP BY 1, 2), "
        f"o2 AS (SELECT unit, author, commits, last_commit, {rh('weight / sum(weight) OVER (PARTITION BY unit)', 4)} AS weighted_share, {rh('commits::DOUBLE / sum(commits) OVER (PARTITION BY unit)::DOUBLE', 4)} AS share FROM o1), "
        f"own AS (SELECT *, row_number() OVER z AS rank, list_reduce(list(weighted_share) OVER (PARTITION BY unit ORDER BY weighted_share DESC, commits DESC, author ROWS UNBOUNDED PRECEDING), lambda a, b: a + b) AS running_share FROM o2 WINDOW z AS (PARTITION BY unit ORDER BY weighted_share DESC, commits DESC, author))"
    )


@query(f"WITH {CF}, {owned_sql('path')} SELECT * FROM own")
def ownership_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.owners(facts.commit_files(spark, sf_dir), "path", NOW)


@query(f"WITH {CF}, {owned_sql('substr(path, 1, 1)')} SELECT * FROM own")
def ownership_by_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.owners(facts.commit_files(spark, sf_dir), F.substring("path", 1, 1), NOW)


@query(f"WITH {CF}, {owned_sql('path')} SELECT unit, count(*) AS authors, coalesce(min(rank) FILTER (running_share >= 0.7::DOUBLE), count(*)) AS bus_factor FROM own GROUP BY unit")
def bus_factor_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.bus_factor(ownership_by_path(spark, sf_dir))


@query(f"WITH {CF}, {owned_sql('path')} SELECT unit, author AS owner, weighted_share, {age('last_commit')} AS inactive_days, weighted_share >= 0.35::DOUBLE AND {age('last_commit')} >= 90 AS at_risk FROM own WHERE rank = 1")
def ownership_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.risk(ownership_by_path(spark, sf_dir), NOW, history_days=365, risk_share=0.35)


# JOIN-03..05, ORD-03, GRF-01: co-change and impact --------------------------------------------


def pairs_sql(min_shared: int, threshold: float) -> str:
    return (
        "t AS (SELECT k, path, min(ts) AS ts FROM cf GROUP BY k, path), n AS (SELECT path, count(*) AS n FROM t GROUP BY path), "
        f"p AS (SELECT x.path AS a, y.path AS b, count(*) AS shared, min(x.ts) AS first_shared, max(x.ts) AS last_shared FROM t x JOIN t y ON x.k = y.k AND x.path < y.path GROUP BY 1, 2 HAVING count(*) >= {min_shared}), "
        f"pairs AS (SELECT a, b, shared, na.n AS commits_a, nb.n AS commits_b, {c01('shared::DOUBLE / least(na.n, nb.n)::DOUBLE')} AS coupling, first_shared, last_shared FROM p JOIN n na ON na.path = a JOIN n nb ON nb.path = b WHERE shared::DOUBLE / least(na.n, nb.n)::DOUBLE >= {threshold}::DOUBLE)"
    )


@query(f"WITH {CF}, {pairs_sql(3, 0.05)} SELECT * FROM pairs")
def cochange_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.pairs(facts.commit_files(spark, sf_dir), 3, 0.05)


@query(f"WITH {CF}, {pairs_sql(3, 0.05)} SELECT pairs.a, pairs.b, shared, coupling FROM pairs JOIN part x ON x.p_partkey = CAST(pairs.a AS BIGINT) JOIN part y ON y.p_partkey = CAST(pairs.b AS BIGINT) WHERE x.p_brand <> y.p_brand AND NOT EXISTS (SELECT 1 FROM part e WHERE (e.p_brand = x.p_brand AND e.p_type = y.p_brand) OR (e.p_brand = y.p_brand AND e.p_type = x.p_brand))")
def cochange_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = facts.table(spark, sf_dir, "part")
    packages = part.select(F.col("p_partkey").cast("string").alias("path"), F.col("p_brand").alias("package"))
    edges = part.select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst"))
    return coupling.hidden(cochange_pairs(spark, sf_dir), packages, edges).select("a", "b", "shared", "coupling")


STEP = "SELECT path, coupling, via, shared FROM (SELECT e.t AS path, e.coupling, e.f AS via, e.shared, row_number() OVER (PARTITION BY e.t ORDER BY e.coupling DESC, e.f) AS n FROM e JOIN {prev} s ON e.f = s.path WHERE e.t NOT IN ({seen})) WHERE n = 1"
BLAST = (
    f"WITH {SF}, {pairs_sql(3, 0.06)}, e AS (SELECT a AS f, b AS t, coupling, shared FROM pairs UNION ALL SELECT b, a, coupling, shared FROM pairs), s0 AS (SELECT DISTINCT path FROM cf WHERE CAST(path AS BIGINT) <= 3), "
    f"s1 AS ({STEP.format(prev='s0', seen='SELECT path FROM s0')}), s2 AS ({STEP.format(prev='s1', seen='SELECT path FROM s0 UNION ALL SELECT path FROM s1')}), "
    f"s3 AS ({STEP.format(prev='s2', seen='SELECT path FROM s0 UNION ALL SELECT path FROM s1 UNION ALL SELECT path FROM s2')}) "
)


def _blast(spark: SparkSession, sf_dir: str, hops: int) -> DataFrame:
    own = facts.commit_files(spark, sf_dir, "l_suppkey")
    seeds = own.filter(F.col("path").cast("bigint") <= 3).select("path")
    return coupling.expand(coupling.pairs(own, 3, 0.06), seeds, hops)


@query(BLAST + "SELECT path, 1::BIGINT AS hops, coupling, via, shared FROM s1 ORDER BY coupling DESC, shared DESC, path LIMIT 50")
def blast_hop1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blast(spark, sf_dir, 1)


@query(BLAST + "SELECT * FROM (SELECT path, 1::BIGINT AS hops, coupling, via, shared FROM s1 UNION ALL SELECT path, 2, coupling, via, shared FROM s2 UNION ALL SELECT path, 3, coupling, via, shared FROM s3) ORDER BY hops, coupling DESC, shared DESC, path LIMIT 50")
def blast_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blast(spark, sf_dir, 3)


# AGG-18/19: decay -------------------------------------------------------------------------------


@query(f"WITH {CF} SELECT path, max(ts) AS last_commit, {age('max(ts)')} AS age_days, count(DISTINCT k) AS commits FROM cf GROUP BY path HAVING max(ts) <= TIMESTAMP '{NOW}' - INTERVAL 90 DAY")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decay.orphans(facts.commit_files(spark, sf_dir), NOW)


@query(f"WITH {CF}, x AS (SELECT path, author, count(*) AS n FROM cf GROUP BY 1, 2), y AS (SELECT path, author, n, sum(n) OVER (PARTITION BY path)::BIGINT AS commits, row_number() OVER (PARTITION BY path ORDER BY n DESC, author) AS r FROM x) SELECT path, author, commits, {r2('n::DOUBLE / commits')} AS share FROM y WHERE r = 1 AND commits >= 3 AND n::DOUBLE / commits >= 0.4::DOUBLE")
def silos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decay.silos(facts.commit_files(spark, sf_dir), share=0.4)


HALF = "h AS (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders), g AS (SELECT a, (epoch_us(b) - epoch_us(a)) / 86400000000::DOUBLE AS d, (SELECT count(*) FROM orders WHERE epoch_us(o_orderdate) < epoch_us(a) + (epoch_us(b) - epoch_us(a)) // 2) AS p, (SELECT count(*) FROM orders WHERE epoch_us(o_orderdate) >= epoch_us(a) + (epoch_us(b) - epoch_us(a)) // 2) AS r FROM h)"
HALF_LIFE = f"SELECT {age('a')} AS history_days, {r2('p / (d / 2)')} AS prior_rate, {r2('r / (d / 2)')} AS recent_rate, CASE WHEN p <= 0 THEN 0 WHEN r <= 0 THEN -1 WHEN r::DOUBLE / p >= 1 THEN 0 ELSE {r2('ln(0.5::DOUBLE) / ln(r::DOUBLE / p) * (d / 2)')} END::DOUBLE AS half_life_days, NULL::VARCHAR AS reason FROM g"


@query(f"WITH {HALF} {HALF_LIFE}")
def half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decay.half_life(facts.commits(spark, sf_dir), NOW)


# SRC-01/02, LEX-04..07, PRJ-01..05, AGG-01..03, JOIN-01: code -------------------------------------


@query(f"WITH {FILES} SELECT path, lang AS language, total_lines, code_lines AS filled_lines FROM rec")
def file_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.line_counts(facts.files(spark, sf_dir))


@query(f"WITH {FILES} SELECT path, branch_points FROM rec")
def branch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.files(spark, sf_dir).select("path", code.branch_count(F.col("content")).alias("branch_points"))


@query(f"WITH {FILES} SELECT lang AS language, count(*) AS files, sum(code_lines)::BIGINT AS lines, count(*) FILTER (is_test) AS tests FROM rec GROUP BY 1 ORDER BY lines DESC, 1 LIMIT 8")
def language_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.languages(facts.records(spark, sf_dir).withColumn("language", F.col("lang")))


@query(f"WITH {FILES} SELECT level, count(*) AS files FROM rec2 GROUP BY level")
def complexity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.records(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("files"))


SUMMARY = f"SELECT count(*) AS files, 0::BIGINT AS functions, sum(branch_points)::BIGINT AS branch_points, {r2('avg(complexity)')} AS avg_complexity, max(complexity) AS max_complexity, 0::BIGINT AS max_nesting, count(*) FILTER (level = 'high') AS high_files, count(*) FILTER (level = 'very_high') AS very_high_files, (SELECT path FROM rec2 ORDER BY complexity DESC, string_split(path, '/') LIMIT 1) AS max_complexity_file FROM rec2"


@query(f"WITH {FILES} {SUMMARY}")
def complexity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.complexity_summary(facts.records(spark, sf_dir))


STATS = f"SELECT count(*) AS files, count(*) FILTER (NOT is_test) AS source_files, count(*) FILTER (is_test) AS test_files, sum(total_lines)::BIGINT AS total_lines, sum(code_lines)::BIGINT AS code_lines, coalesce(sum(code_lines) FILTER (is_test), 0)::BIGINT AS test_lines, max(code_lines) AS largest_file_lines, 1::BIGINT AS languages, {r2('sum(code_lines)::DOUBLE / count(*)')} AS avg_file_lines, {r2('coalesce(count(*) FILTER (is_test)::DOUBLE / nullif(count(*) FILTER (NOT is_test), 0), 0)')} AS test_file_ratio, {r2('coalesce(coalesce(sum(code_lines) FILTER (is_test), 0)::DOUBLE / nullif(sum(code_lines), 0)::DOUBLE, 0)')} AS test_line_ratio FROM rec2"


@query(f"WITH {FILES} {STATS}")
def test_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.code_stats(facts.records(spark, sf_dir))


def _file_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn of files: the part of the same number."""
    own = churn_by_path(spark, sf_dir).select(F.col("path").alias("part"), "added", "deleted")
    named = facts.files(spark, sf_dir).select("path", F.regexp_extract("path", r"([0-9]+)\.py$", 1).alias("part"))
    return named.join(own, "part").select("path", "added", "deleted")


HOT = "hot AS (SELECT rec2.path, 'Python' AS language, true AS complexity_measured, code_lines, coalesce(added + deleted, 0)::BIGINT AS churn, complexity, level, code_lines >= 10 AND coalesce(added + deleted, 0) >= 30 AND level IN ('high', 'very_high') AS confirmed FROM rec2 LEFT JOIN churn ON churn.path = regexp_extract(rec2.path, '([0-9]+)\\.py$', 1) WHERE code_lines >= 5)"
REASON = (
    "CASE WHEN confirmed THEN printf('%d code lines (at least 10), %d changed (at least 30), %s complexity (at least high)', code_lines, churn, level) ELSE printf('%d code lines; not confirmed: ', code_lines) || "
    "array_to_string(list_filter([CASE WHEN code_lines < 10 THEN printf('%d of 10 lines', code_lines) END, CASE WHEN churn < 30 THEN printf('%d of 30 changed lines', churn) END, CASE WHEN level NOT IN ('high', 'very_high') THEN level || ' complexity, below high' END], lambda x: x IS NOT NULL), ', ') END AS reason"
)


@query(f"WITH {FILES}, {CF}, {CHURN}, {HOT} SELECT *, {REASON} FROM hot ORDER BY confirmed DESC, code_lines DESC, path LIMIT 10")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.hotspots(facts.records(spark, sf_dir), _file_churn(spark, sf_dir), threshold=5, lines=10)


DEFINITIONS = ", ".join(f"'{w}'" for w in code.DEFINITION_WORDS)
LEXICAL = (
    "x0 AS (SELECT path, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS raw FROM f1), "
    r"""x1 AS (SELECT path, i, trim(split_part(regexp_replace(trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)), '"(?:\\.|[^"\\])*(?:"|\\?$)|''(?:\\.|[^''\\])*(?:''|\\?$)', '""', 'g'), '#', 1), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM x0), """
    "x2 AS (SELECT *, lower(regexp_extract(line, '^[A-Za-z0-9_]*')) IN (" + DEFINITIONS + ") AS def, "
    f"(len(list_filter(regexp_extract_all(line, '[A-Za-z0-9_]+'), lambda w: list_contains([{BRANCHES}], lower(w)))) + (length(line) - length(replace(line, '&&', ''))) // 2 + (length(line) - length(replace(line, '||', ''))) // 2)::BIGINT AS n FROM x1 WHERE line <> ''), "
    "x3 AS (SELECT *, count(*) FILTER (def) OVER (PARTITION BY path ORDER BY i) AS unit FROM x2), x4 AS (SELECT path, max(n) AS most FROM (SELECT path, unit, sum(n) AS n FROM x3 GROUP BY 1, 2) GROUP BY 1), "
    "x5 AS (SELECT path, i, unnest(regexp_extract_all(line, '[{}]')) AS brace, unnest(range(len(regexp_extract_all(line, '[{}]')))) AS k FROM x2), x6 AS (SELECT path, i, k, sum(CASE brace WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY i, k) AS s FROM x5), "
    "x7 AS (SELECT path, max(d) AS deep FROM (SELECT path, s - least(0, min(s) OVER (PARTITION BY path ORDER BY i, k)) AS d FROM x6) GROUP BY 1), "
    "x8 AS (SELECT path, count(*) AS code_lines, count(*) FILTER (def) AS functions, sum(n)::BIGINT AS branch_points FROM x2 GROUP BY 1), "
    "x9 AS (SELECT f1.path, len(ls)::BIGINT AS total_lines, coalesce(code_lines, 0) AS code_lines, coalesce(functions, 0) AS functions, coalesce(branch_points, 0) AS branch_points, coalesce(most, 0)::BIGINT AS max_function_branches, coalesce(deep, 0)::BIGINT AS max_nesting, "
    "(coalesce(branch_points, 0) + greatest(coalesce(functions, 0), 1))::DOUBLE / greatest(coalesce(functions, 0), 1) AS mean FROM f1 LEFT JOIN x8 USING (path) LEFT JOIN x4 USING (path) LEFT JOIN x7 USING (path))"
)


@query(
    f"WITH {FILES}, {LEXICAL} SELECT path, 'Python' AS language, total_lines, code_lines, functions, branch_points, max_function_branches, max_nesting, regexp_matches(path, '/tests/') AS is_test, true AS complexity_measured, {r2('mean')} AS complexity, "
    "CASE WHEN mean <= 10 THEN 'low' WHEN mean <= 20 THEN 'moderate' WHEN mean <= 50 THEN 'high' ELSE 'very_high' END AS level, max_function_branches + 1 AS max_function_complexity, " + r2("coalesce(branch_points * 100 / nullif(code_lines, 0)::DOUBLE, 0)") + " AS density FROM x9"
)
def lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line scanner over all texts, read as Python source."""
    return code.measure(facts.files(spark, sf_dir).withColumn("language", F.lit("Python")))


@query(f"WITH {FILES} SELECT path, complexity, row_number() OVER (ORDER BY complexity DESC, string_split(path, '/')) AS place FROM rec2 ORDER BY complexity DESC, string_split(path, '/') LIMIT 10")
def worst_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = code.worst_files(facts.records(spark, sf_dir)).select("path", "complexity")
    return own.withColumn("place", F.row_number().over(Window.orderBy(F.desc("complexity"), F.split("path", "/"))).cast("bigint"))


# SCR-01..06, PRJ-05: health of every root (priority) -------------------------------------------------

SCORES = (
    "s0 AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS root, count(*) AS commits, sum(floor(o_totalprice)) AS price, sum(CASE WHEN o_totalprice > 300000 THEN floor(o_totalprice) ELSE 0 END) AS hot, max(floor(o_totalprice)) AS top, "
    f"{age('max(o_orderdate)')} AS idle, count(DISTINCT o_orderpriority) AS authors, sum(o_custkey % 11)::BIGINT AS direct, count(DISTINCT o_orderstatus) FILTER (o_orderstatus <> 'P') AS ecosystems, bool_and(o_orderstatus <> 'O') AS locked FROM orders GROUP BY 1), "
    f"s00 AS (SELECT *, price / commits / 1000 AS avg_lines, {r2('top / price')} AS concentration, {r2('commits * 7 / least(90, idle + 1)::DOUBLE')} AS pace FROM s0)"
)
SIZE = "CASE WHEN avg_lines > 150 THEN 100 * (1 - " + c01("(avg_lines - 150) / 150") + ") WHEN avg_lines < 25 THEN 100 * (1 - " + c01("(25 - avg_lines) / 15") + ") ELSE 100 END"
CODE_SQL = r2(f"0.5::DOUBLE * ({SIZE}) + 0.3::DOUBLE * (100 * (1 - {c01('hot / price / 0.3::DOUBLE')})) + 0.2::DOUBLE * (100 * least(1::DOUBLE, commits * 10 / authors::DOUBLE / 40))")
CADENCE_SQL = "(CASE WHEN pace >= 8 THEN 100::DOUBLE WHEN pace <= 0.5::DOUBLE THEN 0 ELSE (pace - 0.5::DOUBLE) / 7.5::DOUBLE * 100 END)"
WEIGHT_SQL = "(CASE WHEN idle + 1 < 28 THEN 0::DOUBLE ELSE 0.3::DOUBLE END)"
GIT_SQL = r2(f"({CADENCE_SQL} * {WEIGHT_SQL} + 100 * (1 - {c01('idle / 180::DOUBLE')}) * 0.25::DOUBLE + 100 * (1 - {c01('concentration / 0.6::DOUBLE')}) * 0.25::DOUBLE + (CASE WHEN authors <= 1 THEN 85::DOUBLE ELSE 100 END) * 0.2::DOUBLE) / ({WEIGHT_SQL} + 0.7::DOUBLE)")
DEP_SQL = "CASE WHEN ecosystems = 0 THEN 90 ELSE " + r2(f"0.5::DOUBLE * (100 * (1 - {c01('direct / 50::DOUBLE')})) + 0.3::DOUBLE * (CASE WHEN locked THEN 100::DOUBLE ELSE 80 END) + 0.2::DOUBLE * (CASE WHEN ecosystems <= 1 THEN 100::DOUBLE ELSE 100 / ecosystems::DOUBLE END)") + " END"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root for each day of orders, with the figures that scores and risks need."""
    price = F.floor("o_totalprice").cast("double")
    own = facts.table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("root")).agg(
        F.count(F.lit(1)).alias("commits"), F.sum(price).alias("price"), F.sum(F.when(F.col("o_totalprice") > 300000, price).otherwise(0.0)).alias("hot"), F.max(price).alias("top"),
        num.age_days(F.max("o_orderdate"), F.lit(NOW)).alias("idle"), F.countDistinct("o_orderpriority").alias("authors"), F.sum(F.col("o_custkey") % 11).cast("bigint").alias("direct"),
        F.countDistinct(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))).alias("ecosystems"), F.bool_and(F.col("o_orderstatus") != "O").alias("locked"),
    )
    span = F.least(F.lit(90).cast("bigint"), F.col("idle") + 1)
    return own.select("*", (F.col("price") / F.col("commits") / 1000).alias("avg_lines"), num.round2(F.col("top") / F.col("price")).alias("concentration"), span.alias("span"), num.round2(num.ratio(F.col("commits") * 7, span)).alias("pace"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).select(
        "root", health.code_score("avg_lines", "hot", "price", F.col("commits") * 10, "authors").alias("code_score"), health.dependency_score("direct", "locked", "ecosystems").alias("dependency_score"),
        health.git_score("commits", "pace", "span", "idle", "concentration", "authors").alias("git_score"),
    )


@query(f"WITH {SCORES} SELECT root, {CODE_SQL} AS code_score FROM s00")
def health_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("root", "code_score")


@query(f"WITH {SCORES} SELECT root, {DEP_SQL} AS dependency_score FROM s00")
def health_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("root", "dependency_score")


@query(f"WITH {SCORES} SELECT root, {GIT_SQL} AS git_score FROM s00")
def health_git(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("root", "git_score")


METRICS = f"s1 AS (SELECT root, {CODE_SQL} AS c, {DEP_SQL} AS d, {GIT_SQL} AS g FROM s00), m AS (SELECT root, 'code' AS key, c AS score, 0.4::DOUBLE AS w FROM s1 UNION ALL SELECT root, 'dependency', d, 0.3::DOUBLE FROM s1 UNION ALL SELECT root, 'git', g, 0.3::DOUBLE FROM s1)"


@query(f"WITH {SCORES}, {METRICS}, t AS (SELECT root, (0::DOUBLE + c * 0.4::DOUBLE + d * 0.3::DOUBLE + g * 0.3::DOUBLE) / (0::DOUBLE + 0.4::DOUBLE + 0.3::DOUBLE + 0.3::DOUBLE) AS raw FROM s1), k AS (SELECT root, key, row_number() OVER (PARTITION BY root ORDER BY score, w DESC, key) AS n FROM m) SELECT root, {r2('raw')} AS score, {grade_sql('raw')} AS grade, key AS weakest, CASE WHEN raw >= 85 THEN 'excellent' WHEN raw >= 70 THEN 'good' WHEN raw >= 55 THEN 'fair' WHEN raw >= 40 THEN 'weak' ELSE 'poor' END AS label FROM t JOIN k USING (root) WHERE n = 1")
def health_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.total(health.metrics(_scored(spark, sf_dir), ["root"]), ["root"])


@query(f"WITH {SCORES}, {METRICS} SELECT root, key, CASE WHEN {r2('100 - score')} >= 60 THEN 'critical' WHEN {r2('100 - score')} >= 40 THEN 'high' ELSE 'medium' END AS severity, {r2('100 - score')} AS deficit FROM m WHERE 100 - score >= 10")
def metric_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.metric_risks(health.metrics(_scored(spark, sf_dir), ["root"]), ["root"])


# RSK-01..08, SET-05, ORD-02, FND-01/02: risks and findings -----------------------------------------


def cap_sql(x: str) -> str:
    return f"(CASE WHEN ({x}) <= 0 THEN 0 WHEN ({x}) >= 15 THEN 15 ELSE {r2(x)} END)::DOUBLE"


ECO = (
    "eco AS (SELECT s_name AS root, CASE s_suppkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'go' ELSE 'python' END AS name, CASE s_suppkey % 3 WHEN 0 THEN 'package.json' WHEN 1 THEN 'go.mod' ELSE 'pyproject.toml' END AS manifest, "
    "CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'yarn.lock' WHEN s_suppkey % 3 = 1 THEN 'go.sum' ELSE 'uv.lock' END AS lockfile, (s_suppkey * 7 % 60)::BIGINT AS direct, (s_suppkey * 7 % 60 * (s_suppkey % 25))::BIGINT AS transitive, s_suppkey % 4 = 0 AS drift, s_suppkey % 5 = 0 AS stale FROM supplier)"
)


def _ecosystems(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, k = facts.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    pick = lambda *names: F.when(k % 3 == 0, names[0]).when(k % 3 == 1, names[1]).otherwise(names[2])
    direct = (k * 7 % 60).cast("bigint")
    return own.select(F.col("s_name").alias("root"), pick("npm", "go", "python").alias("name"), pick("package.json", "go.mod", "pyproject.toml").alias("manifest"), F.when(k % 4 != 0, pick("yarn.lock", "go.sum", "uv.lock")).alias("lockfile"), direct.alias("direct"), (direct * (k % 25)).cast("bigint").alias("transitive"), (k % 4 == 0).alias("drift"), (k % 5 == 0).alias("stale"))


BY_SOURCE = "src AS (SELECT split_part(path, '/', 1) AS root, count(*) FILTER (is_test) AS t, count(*) FILTER (NOT is_test) AS s FROM rec2 GROUP BY 1)"
RISKS = (
    f"r0 AS (SELECT 'repo' AS root, 'code.hotspot.' || path AS id, 'code' AS category, path AS subject, {cap_sql('(3 + 2 * code_lines / 500::DOUBLE + 1.5::DOUBLE * churn / 30 + 2 * complexity / 20) * 0.4::DOUBLE')} AS impact FROM hot WHERE confirmed "
    f"UNION ALL SELECT 'repo', 'code.complexity.distribution', 'complexity', worst, {cap_sql('v::DOUBLE / n * 30 * 0.4::DOUBLE')} FROM (SELECT count(*) FILTER (level = 'very_high') AS v, count(*) AS n, (SELECT path FROM rec2 ORDER BY complexity DESC, string_split(path, '/') LIMIT 1) AS worst FROM rec2) WHERE v > 0 "
    f"UNION ALL SELECT 'repo', 'code.complexity.' || path, 'complexity', path, {cap_sql('complexity / 20 * 8 * 0.4::DOUBLE')} FROM (SELECT * FROM rec2 ORDER BY complexity DESC, string_split(path, '/') LIMIT 1) WHERE level IN ('high', 'very_high') "
    f"UNION ALL SELECT root, 'testing.none', 'testing', '', 4 FROM src WHERE t = 0 AND s > 0 "
    f"UNION ALL SELECT root, 'testing.ratio', 'testing', '', {cap_sql('(0.15::DOUBLE - q) / 0.15::DOUBLE * 6 * 0.4::DOUBLE')} FROM (SELECT root, t, {r2('t::DOUBLE / s')} AS q FROM src WHERE s > 0) WHERE t > 0 AND q < 0.15::DOUBLE "
    f"UNION ALL SELECT root, 'dependency.drift.' || name, 'dependency', manifest, 1.5::DOUBLE FROM eco WHERE drift UNION ALL SELECT root, 'dependency.lockfile_stale.' || name, 'dependency', lockfile, 1 FROM eco WHERE stale AND NOT drift "
    f"UNION ALL SELECT root, 'dependency.transitive.' || name, 'dependency', manifest, {cap_sql('(transitive::DOUBLE / direct::DOUBLE - 10) / 10 * 4 * 0.3::DOUBLE')} FROM eco WHERE direct > 5 AND transitive::DOUBLE / direct::DOUBLE >= 10 "
    f"UNION ALL SELECT root, 'git.bus_factor', 'git', '', {cap_sql('concentration * 6 * 0.3::DOUBLE')} FROM s00 WHERE authors <= 1 AND concentration >= 0.7::DOUBLE UNION ALL SELECT root, 'git.churn_concentration', 'git', 'top-' || commits, {cap_sql('concentration * 5 * 0.3::DOUBLE')} FROM s00 WHERE concentration >= 0.6::DOUBLE "
    f"UNION ALL SELECT root, 'git.stale', 'git', '', {cap_sql('idle / 180::DOUBLE * 4 * 0.3::DOUBLE')} FROM s00 WHERE idle >= 180 "
    f"UNION ALL SELECT root, 'score.' || key, key, '', {cap_sql('(100 - score) * w')} FROM m WHERE 100 - score >= 10)"
)
ALL_RISKS = f"WITH {FILES}, {CF}, {CHURN}, {HOT}, {ECO}, {BY_SOURCE}, {SCORES}, {METRICS}, {RISKS}"


def _hot(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> DataFrame:
    return code.hotspots(facts.records(spark, sf_dir) if records is None else records, _file_churn(spark, sf_dir), threshold=5, limit=None, lines=10)


def _git_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).select("root", "commits", F.col("authors").alias("bus_factor"), F.col("concentration").alias("top_share"), "concentration", F.concat(F.lit("top-"), F.col("commits").cast("string")).alias("top_path"), F.col("idle").alias("days_since_commit"))


@query(f"{ALL_RISKS} SELECT root, id, category, subject, impact, {severity_sql('impact')} AS severity FROM r0")
def risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six families: files as one repository, folders, suppliers and days as further ones."""
    records = facts.records(spark, sf_dir).persist()
    repo = lambda frame: frame.withColumn("root", F.lit("repo"))
    folders = code.code_stats(records.withColumn("root", F.split("path", "/")[0]), by="root")
    keys = ["root"]
    return risks.assess(
        risks.hotspot_risks(repo(_hot(spark, sf_dir, records)), keys), risks.complexity_risks(repo(code.complexity_summary(records)), repo(code.worst_files(records, 1)), keys), risks.testing_risks(folders, keys),
        risks.dependency_risks(_ecosystems(spark, sf_dir), keys), risks.git_risks(_git_stats(spark, sf_dir), keys), risks.dimension_risks(health.metrics(_scored(spark, sf_dir), keys), keys),
    )


@query(f"{ALL_RISKS} SELECT {severity_sql('impact')} AS severity, count(*) AS risks FROM r0 GROUP BY 1")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("risks"))


@query(f"{ALL_RISKS}, v AS (SELECT *, {severity_sql('impact')} AS severity FROM r0), w AS (SELECT root, id, severity, impact, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS sr FROM v) SELECT root, id, severity, row_number() OVER (ORDER BY sr DESC, impact DESC, id, root) AS place FROM w ORDER BY place LIMIT 100")
def risks_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of risks: severity, impact, id."""
    first = risks.ordered(risk_rules(spark, sf_dir)).orderBy(F.desc(pred.severity_rank("severity")), F.desc("impact"), "id", "root").limit(100)
    return first.select("root", "id", "severity", F.row_number().over(Window.orderBy(F.desc(pred.severity_rank("severity")), F.desc("impact"), "id", "root")).cast("bigint").alias("place"))


@query(f"{ALL_RISKS} SELECT root, id, impact FROM r0 WHERE impact >= 6 AND impact < 12")
def risks_of_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risks.filtered(risk_rules(spark, sf_dir), "High").select("root", "id", "impact")


GAPS = "SELECT count(*) FILTER (n_chars > 5000) AS t, count(*) FILTER (doc_id % 100 = 0) AS k FROM documents"


@query(
    f"WITH {FILES}, {CF}, {CHURN}, {HOT} SELECT CASE WHEN confirmed THEN 'high' ELSE 'low' END AS severity, 'code' AS category, CASE WHEN confirmed THEN 'Confirmed hotspot' ELSE 'Large file / hotspot candidate' END AS title, reason AS detail, path AS subject FROM (SELECT *, {REASON} FROM hot) "
    "UNION ALL SELECT 'medium', 'complexity', 'Very high estimated complexity', printf('%d file(s) above the bound, at most %.1f in %s', v, m, p), '' FROM (SELECT count(*) FILTER (level = 'very_high') AS v, max(complexity) AS m, (SELECT path FROM rec2 ORDER BY complexity DESC, string_split(path, '/') LIMIT 1) AS p FROM rec2) WHERE v > 0 "
    f"UNION ALL SELECT 'low', 'code', 'Oversized files skipped', printf('%d file(s) above the size cap are not in the counts', t), '' FROM ({GAPS}) WHERE t > 0 UNION ALL SELECT 'info', 'code', 'Unreadable entries skipped', printf('%d entries could not be read', k), '' FROM ({GAPS}) WHERE k > 0"
)
def finding_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = facts.records(spark, sf_dir).persist()
    gaps = facts.table(spark, sf_dir, "documents").agg(F.count_if(F.col("n_chars") > 5000).alias("truncated"), F.count_if(F.col("doc_id") % 100 == 0).alias("skipped"))
    return risks.code_findings(_hot(spark, sf_dir, records), code.code_stats(records), code.complexity_summary(records), gaps)


@query(
    f"WITH {SCORES}, g AS (SELECT root, commits - 1 AS commits, commits * 4 AS window_commits, idle, authors, concentration, CASE WHEN commits = 2 THEN 'shallow copy' END AS note FROM s00) "
    "SELECT root, 'medium' AS severity, 'git' AS category, 'No commits on HEAD' AS title, 'no commit can be reached' AS detail, '' AS subject FROM g WHERE commits = 0 "
    "UNION ALL SELECT root, 'medium', 'git', 'Stale repository', printf('the last commit is %d days old, the window 90', idle), '' FROM g WHERE commits > 0 AND idle > 90 "
    "UNION ALL SELECT root, 'high', 'git', 'Bus factor of 1', printf('one author holds most of %d commits in the window', window_commits), '' FROM g WHERE commits > 0 AND authors <= 1 AND window_commits >= 10 "
    "UNION ALL SELECT root, 'high', 'git', 'Churn concentrated in few files', printf('the first three of %d changed files hold %.1f%% of the change', commits, 50.0::DOUBLE), 'top-' || (commits + 1) FROM g WHERE commits > 0 AND concentration >= 0.5::DOUBLE "
    "UNION ALL SELECT root, 'info', 'git', 'Partial git data', note, '' FROM g WHERE commits > 0 AND note IS NOT NULL"
)
def git_finding_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _git_stats(spark, sf_dir).withColumns({"window_commits": F.col("commits") * 4, "note": F.when(F.col("commits") == 2, "shallow copy"), "rate": F.lit(0.5)})
    own = own.withColumn("commits", F.col("commits") - 1)
    return risks.git_findings(own.withColumn("paths", F.col("commits")), keys=["root"])


@query(
    f"WITH {ECO} SELECT root, 'high' AS severity, 'dependency' AS category, 'Missing lockfile for ' || manifest AS title, printf('%s declares %d direct dependencies and no lockfile pins them', manifest, direct) AS detail, manifest AS subject FROM eco WHERE drift "
    "UNION ALL SELECT root, 'low', 'dependency', 'Lockfile older than manifest', printf('%s changed after %s', manifest, coalesce(lockfile, 'null')), lockfile FROM eco WHERE stale "
    "UNION ALL SELECT root, 'medium', 'dependency', 'Large direct dependency surface', printf('%d direct %s dependencies', direct, name), manifest FROM eco WHERE direct > CASE WHEN name = 'python' THEN 40 ELSE 50 END"
)
def dependency_finding_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risks.dependency_findings(_ecosystems(spark, sf_dir), ["root"])


# GAT-01/02, JOIN-15: gates ---------------------------------------------------------------------------

SNAP = f"snap AS (SELECT o_orderpriority AS root, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS id, {r2('count(*) FILTER (o_orderstatus = chr(70)) * 100::DOUBLE / count(*)')} AS score, count(*) FILTER (o_totalprice > 300000) AS risk_count, count(*) AS files FROM orders GROUP BY 1, 2)"


LIMITS = {"min_health_score": 45, "max_health_drop": 2, "max_complexity_increase": 3, "max_risk_count": 0, "max_hotspots": 5, "fail_on_drift": True, "require_tests": True, "max_files": None}
GATED = "gt AS (SELECT *, files / 10::DOUBLE AS avg_complexity, files % 9 AS confirmed_hotspots, id % 7 = 0 AS dependency_drift, files AS source_files, CASE WHEN id % 5 = 0 THEN 0 ELSE 3 END AS test_files, lag(score) OVER w AS previous_score, lag(files / 10::DOUBLE) OVER w AS previous_complexity FROM snap WINDOW w AS (PARTITION BY root ORDER BY id))"


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = facts.snapshots(spark, sf_dir).withColumns({"avg_complexity": F.col("files") / F.lit(10.0), "confirmed_hotspots": F.col("files") % 9, "dependency_drift": F.col("id") % 7 == 0, "source_files": F.col("files"), "test_files": F.when(F.col("id") % 5 == 0, 0).otherwise(3)})
    return history.with_previous(own, {"previous_score": "score", "previous_complexity": "avg_complexity"})


@query(
    f"WITH {SNAP}, {GATED} SELECT root, id, 'min_health_score' AS rule, score AS actual, 45::DOUBLE AS bound FROM gt WHERE score < 45 UNION ALL SELECT root, id, 'max_health_drop', previous_score - score, 2 FROM gt WHERE previous_score - score > 2 "
    "UNION ALL SELECT root, id, 'max_complexity_increase', avg_complexity - coalesce(previous_complexity, 0), 3 FROM gt WHERE avg_complexity - coalesce(previous_complexity, 0) > 3 UNION ALL SELECT root, id, 'max_risk_count', risk_count, 0 FROM gt WHERE risk_count > 0 "
    "UNION ALL SELECT root, id, 'max_hotspots', confirmed_hotspots, 5 FROM gt WHERE confirmed_hotspots > 5 UNION ALL SELECT root, id, 'fail_on_drift', 1, 1 FROM gt WHERE dependency_drift UNION ALL SELECT root, id, 'require_tests', 0, 1 FROM gt WHERE source_files > 0 AND test_files = 0"
)
def gate_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risks.breaches(_gated(spark, sf_dir), LIMITS, ["root", "id"])


@query(
    f"{ALL_RISKS}, {SNAP}, {GATED}, b AS (SELECT root, id, score, (id % 11) / 100::DOUBLE AS now_ratio, (id % 7) / 50::DOUBLE AS was FROM gt) SELECT root, id::VARCHAR AS id, 'fail_under_health' AS rule, score AS actual, 50::DOUBLE AS bound, '' AS subject FROM b WHERE score < 50 "
    f"UNION ALL SELECT root, id::VARCHAR, 'fail_on_test_ratio_drop', {r2('(was - now_ratio) * 100')}, 5, '' FROM b WHERE (was - now_ratio) * 100 > 5 UNION ALL SELECT root, '', 'fail_on_critical_risk', impact, 0, r0.id FROM r0 WHERE impact >= 12"
)
def ci_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _gated(spark, sf_dir).select("root", F.col("id").cast("string").alias("id"), "score", ((F.col("id") % 11) / F.lit(100.0)).alias("test_file_ratio"), ((F.col("id") % 7) / F.lit(50.0)).alias("previous_test_ratio"))
    found = risk_rules(spark, sf_dir).select("root", "severity", "impact", F.col("id").alias("risk"))
    hit = risks.ci_breaches(own.limit(0), found.withColumnRenamed("risk", "id"), critical=True, keys=["root"]).withColumn("id", F.lit(""))
    return risks.ci_breaches(own, found, 50, 5, keys=["root", "id"]).unionByName(hit)


@query(f"WITH {SCORES}, {METRICS}, p AS (SELECT *, lag(c) OVER w AS pc, lag(d) OVER w AS pd, lag(g) OVER w AS pg FROM s1 WINDOW w AS (ORDER BY root)), f AS (SELECT root, 1 AS position, 'Code' AS label, c AS value, pc AS before, '' AS unit FROM p UNION ALL SELECT root, 2, 'Dependencies', d, pd, '' FROM p UNION ALL SELECT root, 3, 'Testing', c / 100 * 100, pc / 100 * 100, '%' FROM p UNION ALL SELECT root, 4, 'Maintainability', g, pg, '' FROM p UNION ALL SELECT root, 5, 'Build', NULL, NULL, '' FROM p), h AS (SELECT *, value - before AS delta FROM f) SELECT *, CASE WHEN value IS NULL THEN 'Not measured' WHEN before IS NULL THEN 'No baseline' WHEN abs(delta) < 0.5::DOUBLE THEN 'Stable' WHEN delta > 0 THEN 'Improved' WHEN delta <= -10 THEN 'Regression' ELSE 'Dropped' END AS status FROM h")
def impact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a build's report, each day against the day before."""
    own = _scored(spark, sf_dir).withColumn("test_file_ratio", F.col("code_score") / 100)
    before = Window.orderBy("root")  # a row for each day
    names = ("code_score", "dependency_score", "git_score", "test_file_ratio")
    return health.categories(own.withColumns({f"previous_{c}": F.lag(c).over(before) for c in names}), ["root"])


# SRC-26, PRJ-12/13, AGG-23, JOIN-06/14, GAP-01..03: runtime --------------------------------------------


@query(r"SELECT route, count(*) AS hits FROM (SELECT array_to_string(list_transform(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]+', ''), '/'), lambda s: CASE WHEN regexp_matches(s, '^([0-9]+|.{8}-.{4}-.{4}-.{4}-.{12})$') THEN '{id}' ELSE s END), '/') AS route FROM pages) GROUP BY 1")
def route_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = facts.table(spark, sf_dir, "pages")
    return own.groupBy(pred.normal_route(F.regexp_replace("url", "^[a-z]+://[^/]+", "")).alias("route")).agg(F.count(F.lit(1)).alias("hits"))


OBS = "obs AS (SELECT event_type || coalesce(':' || json_extract_string(props, '$.k'), '') AS name, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 THEN json_extract_string(props, '$.k') || '.py' END AS file, CAST(floor(value * 1000) AS BIGINT) AS latency_ns FROM events)"


@query(f"WITH {OBS} SELECT name, count(*) AS hits, sum(latency_ns)::BIGINT AS latency_ns FROM obs GROUP BY 1")
def profile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap.samples(facts.observations(spark, sf_dir))


@query(f"WITH {OBS} SELECT count(*) AS observations, count(file) AS attributed, count(file)::DOUBLE / count(*) AS coverage, CASE WHEN count(file) = 0 THEN 'none' WHEN count(file) < count(*) THEN 'partial' ELSE 'file+function' END AS attribution FROM obs")
def profile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap.coverage(facts.observations(spark, sf_dir), F.col("file").isNotNull())


GAP = (
    f"g0 AS (SELECT path, code_lines, complexity, regexp_extract(path, '[^/]*$') AS base FROM rec2), g1 AS (SELECT base, count(*) AS paths FROM g0 GROUP BY 1), g2 AS (SELECT file AS base, count(*) AS hits, sum(latency_ns)::BIGINT AS latency_ns FROM obs WHERE file IS NOT NULL GROUP BY 1), "
    f"g3 AS (SELECT rec2.path, {rh('100 * (0.45::DOUBLE * ' + c01('rec2.complexity / 50') + ' + 0.3::DOUBLE * ' + c01('rec2.code_lines / 400::DOUBLE') + ' + 0.25::DOUBLE * ' + c01('coalesce(added + deleted, 0) / 300::DOUBLE') + ')', 2)} AS static, "
    "CASE WHEN paths = 1 THEN coalesce(hits, 0) ELSE 0 END::BIGINT AS hits, CASE WHEN paths = 1 THEN coalesce(latency_ns, 0) ELSE 0 END::BIGINT AS latency_ns, paths > 1 AS ambiguous "
    "FROM rec2 JOIN g0 ON g0.path = rec2.path JOIN g1 ON g1.base = g0.base LEFT JOIN g2 ON g2.base = g0.base LEFT JOIN churn ON churn.path = regexp_extract(rec2.path, '([0-9]+)\\.py$', 1) WHERE NOT is_test), "
    f"g4 AS (SELECT path, static, hits, latency_ns, CASE WHEN hits > 0 THEN {rh('static * log10(hits + 1)', 2)} ELSE 0 END::DOUBLE AS critical, CASE WHEN hits > 0 AND static >= 25 THEN 'hot' WHEN hits > 0 THEN 'quiet' ELSE 'phantom' END AS bucket, ambiguous FROM g3)"
)


def _gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = facts.observations(spark, sf_dir).filter("file is not null").groupBy("file").agg(F.count(F.lit(1)).alias("hits"), F.sum("latency_ns").alias("latency_ns"))
    return gap.entries(facts.records(spark, sf_dir), seen, 0.75, _file_churn(spark, sf_dir))


@query(f"WITH {FILES}, {CF}, {CHURN}, {OBS}, {GAP} SELECT bucket, count(*) AS files, sum(hits)::BIGINT AS hits FROM g4 GROUP BY 1")
def gap_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gap(spark, sf_dir).groupBy("bucket").agg(F.count(F.lit(1)).alias("files"), F.sum("hits").alias("hits"))


@query(f"WITH {FILES}, {CF}, {CHURN}, {OBS}, {GAP} SELECT path, static, hits, latency_ns, critical, bucket, ambiguous FROM g4 ORDER BY critical DESC, static DESC, path LIMIT 50")
def critical_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gap(spark, sf_dir).orderBy(F.desc("critical"), F.desc("static"), "path").limit(50)


# WIN-01/02/05, SNK-01/02/21, ORD-07..09: history ---------------------------------------------------------

TREND = f"t AS (SELECT root, id, score, score - lag(score) OVER w AS d0, risk_count - lag(risk_count) OVER w AS risk_delta FROM snap WINDOW w AS (PARTITION BY root ORDER BY id))"


@query(f"WITH {SNAP}, {TREND}, u AS (SELECT root, id, score, {r2('d0')} AS delta, risk_delta FROM t) SELECT root, id, score, delta, risk_delta::BIGINT AS risk_delta, CASE WHEN delta IS NULL THEN '●' WHEN delta > 0.05::DOUBLE THEN '▲' WHEN delta < -0.05::DOUBLE THEN '▼' ELSE '▬' END AS glyph FROM u")
def history_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.trend(facts.snapshots(spark, sf_dir))


@query(f"WITH {SNAP}, n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY id DESC) AS n FROM snap), d AS (SELECT root, max(score) FILTER (n = 1) AS current, max(score) FILTER (n = 2) AS previous FROM n GROUP BY 1) SELECT root, current, previous, {r2('current - previous')} AS delta, CASE WHEN {r2('current - previous')} > 0.05::DOUBLE THEN 'improving' WHEN {r2('current - previous')} < -0.05::DOUBLE THEN 'declining' ELSE 'flat' END AS trend FROM d")
def score_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.score_delta(facts.snapshots(spark, sf_dir))


@query(f"WITH {SNAP} SELECT root, id, score, risk_count, files FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY id DESC) AS n FROM snap) WHERE n <= 12")
def history_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.prune(facts.snapshots(spark, sf_dir), 12)


@query(f"WITH {SNAP} SELECT root, id, score, risk_count, files FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY id DESC) AS n FROM snap) WHERE n = 1")
def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(facts.snapshots(spark, sf_dir))


@query(f"WITH {SNAP} SELECT root, id, score, risk_count, files FROM snap WHERE root = '1-URGENT' ORDER BY id DESC LIMIT 60")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.page(facts.snapshots(spark, sf_dir), "1-URGENT", 60)


@query(f"WITH {SNAP} SELECT root, count(*) AS records, arg_min(score, id) AS first, arg_max(score, id) AS latest, max(score) AS best, min(score) AS worst, {r2('avg(score)')} AS average, {r2('arg_max(score, id) - arg_min(score, id)')} AS change FROM snap GROUP BY 1")
def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.summary(facts.snapshots(spark, sf_dir))


# JOIN-09/10: comparison of two revisions -------------------------------------------------------------------


#: The measures of a year's orders, as SQL; prices are cut to whole numbers, so that sums are exact.
SIDE = {
    "score": r2("count(*) FILTER (o_orderstatus = 'F') * 100 / count(*)::DOUBLE"), "code_lines": "count(*)", "total_lines": "sum(floor(o_totalprice))", "source_files": "count(DISTINCT o_custkey)", "test_files": "count(*) FILTER (o_orderstatus = 'P')",
    "test_file_ratio": r2("count(*) FILTER (o_orderstatus = 'P') / count(DISTINCT o_custkey)::DOUBLE"), "avg_file_lines": r2("sum(floor(o_totalprice)) / count(*)"), "hotspots": "count(*) FILTER (o_totalprice > 300000)",
    "confirmed_hotspots": "count(*) FILTER (o_totalprice > 400000)", "max_complexity": "max(floor(o_totalprice))", "avg_complexity": r2("sum(o_custkey)::DOUBLE / count(*)"), "max_nesting": "max(o_custkey % 17)",
    "direct": "count(DISTINCT o_orderstatus)", "total_dependencies": "count(DISTINCT o_custkey % 100)", "transitive": "count(DISTINCT o_custkey % 1000)", "window_commits": "count(*) FILTER (month(o_orderdate) > 9)",
    "authors": "count(DISTINCT o_orderpriority)", "bus_factor": "count(*) FILTER (o_orderpriority = '1-URGENT')", "concentration": r2("max(floor(o_totalprice)) / sum(floor(o_totalprice)) * 1000"),
}


def _side_sql(year: int) -> str:
    return "SELECT " + ", ".join(f"({sql})::DOUBLE AS {name}" for name, sql in SIDE.items()) + f" FROM orders WHERE year(o_orderdate) = {year}"


def _side(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    own = facts.table(spark, sf_dir, "orders").filter(F.year("o_orderdate") == year)
    n, price, buyer = F.count(F.lit(1)), F.floor("o_totalprice").cast("double"), F.col("o_custkey")
    when, many = F.count_if, F.countDistinct
    made = {
        "score": num.round2(when(F.col("o_orderstatus") == "F") * 100 / n.cast("double")), "code_lines": n, "total_lines": F.sum(price), "source_files": many(buyer), "test_files": when(F.col("o_orderstatus") == "P"),
        "test_file_ratio": num.round2(when(F.col("o_orderstatus") == "P") / many(buyer).cast("double")), "avg_file_lines": num.round2(F.sum(price) / n), "hotspots": when(F.col("o_totalprice") > 300000),
        "confirmed_hotspots": when(F.col("o_totalprice") > 400000), "max_complexity": F.max(price), "avg_complexity": num.round2(F.sum(buyer).cast("double") / n), "max_nesting": F.max(buyer % 17),
        "direct": many("o_orderstatus"), "total_dependencies": many(buyer % 100), "transitive": many(buyer % 1000), "window_commits": when(F.month("o_orderdate") > 9),
        "authors": many("o_orderpriority"), "bus_factor": when(F.col("o_orderpriority") == "1-URGENT"), "concentration": num.round2(F.max(price) / F.sum(price) * 1000),
    }
    return own.agg(*[value.alias(name) for name, value in made.items()])


@query(
    f"WITH a AS ({_side_sql(1996)}), b AS ({_side_sql(1997)}), m AS ("
    + " UNION ALL ".join(f"SELECT '{label}' AS label, a.{m} AS before, b.{m} AS after, {way} AS way FROM a, b" for m, (label, _, _, way) in history.MEASURES.items())
    + f"), d AS (SELECT *, {r2('after - before')} AS delta FROM m) SELECT label, before, after, delta, (way * sign(delta))::BIGINT AS better FROM d WHERE delta <> 0"
)
def compare_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.metric_deltas(_side(spark, sf_dir, 1996), _side(spark, sf_dir, 1997)).drop("display")


def _risks_sql(year: int) -> str:
    return f"SELECT CAST(o_custkey AS VARCHAR) AS id, count(*)::DOUBLE AS impact, {severity_sql('count(*)')} AS severity FROM orders WHERE year(o_orderdate) = {year} GROUP BY 1"


@query(
    f"WITH a AS ({_risks_sql(1996)}), b AS ({_risks_sql(1997)}) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'resolved' ELSE 'changed' END AS change, a.impact AS impact_before, b.impact AS impact_after, a.severity AS severity_before, b.severity AS severity_after, "
    "CASE WHEN a.id IS NULL THEN -1 WHEN b.id IS NULL THEN 1 WHEN b.impact < a.impact THEN 1 ELSE -1 END::BIGINT AS better FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.impact <> b.impact OR a.severity <> b.severity"
)
def compare_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.risk_changes(facts.risks(spark, sf_dir, 1996), facts.risks(spark, sf_dir, 1997))


# SRC-28/29, JOIN-11/12, GRF-02: import graph --------------------------------------------------------------------

EDGES = (
    "e0 AS (SELECT a.n_name AS src, b.n_name AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey GROUP BY 1, 2), "
    "e AS (SELECT src, dst FROM e0 WHERE n > 1.3::DOUBLE * (SELECT avg(n) FROM e0)), "
    "k AS (SELECT n_name AS package, r_name AS boundary FROM nation JOIN region ON n_regionkey = r_regionkey), x AS (SELECT src, dst, p.boundary AS f, q.boundary AS t FROM e JOIN k p ON p.package = src JOIN k q ON q.package = dst)"
)


@query(f'WITH {EDGES} SELECT f AS "from", t AS "to", count(*) AS edges FROM x WHERE f <> t GROUP BY 1, 2')
def boundary_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.dependencies(facts.imports(spark, sf_dir), facts.packages(spark, sf_dir))


TOP_REGION = "ASIA"


@query(f"WITH {EDGES}, m AS (SELECT min(package) AS module FROM k) SELECT 'cmd-imported' AS kind, src AS package, dst AS imported, f AS \"from\", t AS \"to\" FROM x WHERE t = '{TOP_REGION}' AND f <> '{TOP_REGION}' UNION ALL SELECT 'root-import', src, dst, f, '' FROM x, m WHERE dst = module AND src <> module")
def boundary_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = facts.packages(spark, sf_dir)
    module = packages.agg(F.min("package")).first()[0]
    return boundaries.violations(facts.imports(spark, sf_dir), packages, module, TOP_REGION)


# SRC-33, JOIN-07/08, MONO-01, GRF-03/04: workspaces ------------------------------------------------------------------


@query(f"WITH {FILES} SELECT p.source AS package, {STATS.removeprefix('SELECT ').replace('FROM rec2', '')} FROM rec2 JOIN (SELECT DISTINCT source FROM documents) p ON starts_with(rec2.path, p.source || '/') GROUP BY 1")
def package_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = facts.table(spark, sf_dir, "documents").select(F.col("source").alias("path")).distinct()
    return workspace.rollup(facts.records(spark, sf_dir), own)


@query(f"WITH {FILES}, p AS (SELECT DISTINCT source AS path FROM documents UNION SELECT DISTINCT source || '/tests' FROM documents) SELECT rec2.path AS subject, min(p.path) AS package FROM rec2 LEFT JOIN p ON rec2.path = p.path OR starts_with(rec2.path, p.path || '/') GROUP BY 1")
def risk_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = facts.table(spark, sf_dir, "documents").select(F.col("source").alias("path")).distinct()
    own = source.union(source.select(F.concat("path", F.lit("/tests"))))
    return workspace.attribute(facts.records(spark, sf_dir).select(F.col("path").alias("subject")), own, "subject", "subject")


@query("SELECT DISTINCT source AS dir FROM documents WHERE regexp_matches(source, '^src[^/]$') AND source <> 'src3' ORDER BY dir LIMIT 200")
def workspace_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = facts.table(spark, sf_dir, "documents").select(F.col("source").alias("dir"))
    return workspace.resolve(dirs, dirs, ["src?"], ["src3"])


# SRC-12..21, PRJ-23/24, AGG-24, FND-03: manifests --------------------------------------------------------------------------


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[^ \\t#].*:\\s*$')))::BIGINT AS yarn, len(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_extract(x, '^\\s*(\\S*)', 1)), lambda x: x <> '')))::BIGINT AS go_sum FROM documents")
def lockfile_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.table(spark, sf_dir, "documents").select("doc_id", sources.yarn_lock_count("text").alias("yarn"), sources.go_sum_count("text").alias("go_sum"))


@query("SELECT p_partkey, trim(translate(lower(p_type || '_x.' || p_partkey), '_.', '--'), '-') AS name FROM part")
def python_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.table(spark, sf_dir, "part").select("p_partkey", pred.python_name(F.concat("p_type", F.lit("_x."), F.col("p_partkey").cast("string"))).alias("name"))


# SET-06, FN-11/12: numeric facts -------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, list_sort(list_filter(list_distinct([CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR)]), lambda x: x <> CAST(o_custkey AS VARCHAR) AND CAST(x AS BIGINT) > 20)) AS unsupported FROM orders")
def numeric_fact_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = facts.table(spark, sf_dir, "orders")
    text = F.concat(F.lit("customer "), F.col("o_custkey").cast("string"), F.lit(" placed order "), F.col("o_orderkey").cast("string"))
    return own.select("o_orderkey", pred.unsupported_numbers(text, F.array(F.col("o_custkey").cast("string"))).alias("unsupported"))


# CI-01..06, LEX-08..12, COG-01, AGG-20..22 ------------------------------------------------------------------------------------------

COG = "c0 AS (SELECT o_custkey AS path, count(*) AS functions, floor(quantile_cont(o_totalprice / 1000, 0.5))::BIGINT AS median_lifetime, max(o_totalprice / 1000) AS max_lifetime, quantile_cont(o_totalprice / 10000, 0.5) AS density, floor(sum(o_orderkey % 7) / count(*)::DOUBLE)::BIGINT AS depth FROM orders GROUP BY 1)"
COG_SCORE = rh("100 * (0.45::DOUBLE * " + c01("(median_lifetime - 20) / 200::DOUBLE") + " + 0.35::DOUBLE * " + c01("density / 20::DOUBLE") + " + 0.2::DOUBLE * " + c01("depth / 6::DOUBLE") + ")", 1)


@query(f"WITH {COG} SELECT *, {COG_SCORE} AS score FROM c0")
def cognitive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = facts.table(spark, sf_dir, "orders")
    return cognitive.files(own.select(F.col("o_custkey").alias("path"), (F.col("o_totalprice") / 1000).alias("lifetime"), (F.col("o_totalprice") / 10000).alias("density"), (F.col("o_orderkey") % 7).alias("depth")))


@query(f"WITH {COG}, c1 AS (SELECT *, {COG_SCORE} AS score FROM c0) SELECT (l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) / 2::DOUBLE AS median, l[-1] AS worst FROM (SELECT list(score ORDER BY score) AS l FROM c1 WHERE NOT functions < 3)")
def cognitive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cognitive.summary(cognitive_files(spark, sf_dir).withColumn("failed", F.col("functions") < 3))


# STR-01..06: bursts of events --------------------------------------------------------------------------------------------------------------


@query("WITH e AS (SELECT user_id AS root, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT root, ts, sum(fresh) OVER (PARTITION BY root ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e) SELECT root, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS events FROM g GROUP BY root, burst")
def session_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.debounced(facts.table(spark, sf_dir, "events"), "6 hours", key="user_id")


from repolytics import catalog_graph, catalog_paths, catalog_sources  # noqa: E402, F401  register their queries
