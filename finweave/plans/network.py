"""The network of transactions and the resolution of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finweave.constants import ADDRESS_WORDS, LEGAL_FORMS
from finweave.functions.scoring import level, rounded
from finweave.functions.text import entity_address, entity_name
from finweave.operators import entity, graph
from finweave.plans.adapter import VALID_SQL, valid, with_account
from finweave.session import materialize
from finweave.sources.tables import load


#: Most hops of the paths from one account in the whole network; their number grows about twentyfold a hop.
PATH_HOPS = 4
#: Least similarity of entities in the queries; the operator's own default is 0.8.
SIMILAR = 0.70


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Valid transactions as edges of type TRANSFER; times in seconds since 1970."""
    return valid(spark, d, "currency").select(F.col("transaction_id").alias("edge_id"), F.col("source_account_id").alias("src"), F.col("destination_account_id").alias("dst"), (F.unix_micros("transaction_timestamp") / F.lit(1e6)).alias("ts"), F.col("amount").cast("double").alias("amount"), "flagged", "currency")


def flagged_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).where("flagged")


def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return graph.centrality(edges(spark, d)).select("node_id", rounded(F.col("centrality"), 6).alias("centrality"))


def network_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.network_stats(edges(spark, d))


def top_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The tenth of the nodes with the highest centrality."""
    return graph.top_nodes(materialize(graph.centrality(edges(spark, d)), "centrality")).select("node_id")


def layering_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.layering_nodes(edges(spark, d)).orderBy("node_id")


def _exposed(spark: SparkSession, d: str) -> DataFrame:
    """The accounts of exposed persons, with their owners."""
    exposed = load(spark, d, "entities").where("pep_flag").select("entity_id")
    return load(spark, d, "accounts").join(exposed, "entity_id", "left_semi").select(F.col("account_id").alias("node_id"), "entity_id")


def _paths(e: DataFrame, sources: DataFrame, max_hops: int) -> DataFrame:
    return graph.suspicious_paths(e, sources.select("node_id"), max_hops).select("source", F.array_join("path", "|").alias("path"), "hops", rounded(F.col("amount"), 4).alias("amount"))


def suspicious_paths(spark: SparkSession, d: str, source: str | None = None, max_hops: int = PATH_HOPS) -> DataFrame:
    """In the whole network, from a named account; by default from the first account of an exposed person."""
    first = _exposed(spark, d).agg(F.min("node_id").alias("node_id")) if source is None else spark.createDataFrame([(source,)], "node_id string")
    return _paths(edges(spark, d), first, max_hops)


def flagged_paths(spark: SparkSession, d: str) -> DataFrame:
    """In the network of flagged transactions, from the accounts of all exposed persons."""
    return _paths(flagged_edges(spark, d), _exposed(spark, d), 5)


def cycle_reachable(spark: SparkSession, d: str) -> DataFrame:
    """Of each account in the whole network, whether money can run in a circle from it."""
    return graph.reaching_cycles(edges(spark, d))


def flagged_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Of each account in the network of flagged transactions, whether flagged money can run in a circle from it."""
    return graph.reaching_cycles(flagged_edges(spark, d))


def network_payload(spark: SparkSession, d: str) -> DataFrame:
    """Flagged edges with both ends' countries and a short label of the amount."""
    e = flagged_edges(spark, d).select("edge_id", F.col("src").alias("source_account_id"), F.col("dst").alias("destination_account_id"), "amount", "currency")
    e = with_account(with_account(e, spark, d, "source_account_id", "s", entity=False), spark, d, "destination_account_id", "t", entity=False)
    a = F.col("amount")
    label = F.when(a >= 1e6, F.concat(rounded(a / 1e6, 2).cast("string"), F.lit("M"))).when(a >= 1e3, F.concat(F.floor(a / 1e3 + 0.5).cast("string"), F.lit("K"))).otherwise(F.floor(a + 0.5).cast("string"))
    return e.select("edge_id", F.col("source_account_id").alias("source"), F.col("destination_account_id").alias("target"), "amount", "currency", F.concat("currency", F.lit(" "), label).alias("label"), F.col("s_country").alias("source_country"), F.col("t_country").alias("target_country"))


def network_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The ends of flagged edges as nodes of type ACCOUNT and their owners as nodes of type ENTITY, each with its risk level."""
    ends = graph.vertices(flagged_edges(spark, d))
    owned = load(spark, d, "accounts").select(F.col("account_id").alias("node_id"), "account_number", "entity_id").join(ends, "node_id")
    owned = owned.join(load(spark, d, "entities").select("entity_id", "name", level(F.col("risk_score")).alias("risk_level")), "entity_id")
    accounts = owned.select("node_id", F.col("account_number").alias("label"), F.lit("ACCOUNT").alias("node_type"), "risk_level")
    return accounts.unionByName(owned.select(F.col("entity_id").alias("node_id"), F.col("name").alias("label"), F.lit("ENTITY").alias("node_type"), "risk_level").distinct())


def er_normalize_name(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "entities").select("entity_id", entity_name(F.col("name")).alias("normalized"))


def er_normalize_address(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "entities").select("entity_id", entity_address(F.col("address")).alias("normalized"))


def er_pairs(spark: SparkSession, d: str) -> DataFrame:
    return entity.similar_pairs(load(spark, d, "entities"), SIMILAR).select("id_a", "id_b", rounded(F.col("similarity"), 6).alias("similarity"))


def er_components(spark: SparkSession, d: str) -> DataFrame:
    return entity.resolve(load(spark, d, "entities"), SIMILAR)


def er_network(spark: SparkSession, d: str) -> DataFrame:
    return entity.network(materialize(er_components(spark, d), "er-groups"))


def er_merged(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "entities")
    return entity.merge(e, materialize(entity.resolve(e, SIMILAR), "er-groups"))


QUERIES = {f.__name__: f for f in (
    degree_centrality, network_stats, top_nodes, layering_nodes, suspicious_paths, flagged_paths, cycle_reachable, flagged_cycles, network_payload, network_nodes, er_normalize_name, er_normalize_address, er_pairs, er_components, er_network, er_merged,
)}

_EDGES = f"""{VALID_SQL}, e AS (SELECT transaction_id AS edge_id, source_account_id AS src, destination_account_id AS dst, epoch_us(transaction_timestamp) / 1e6 AS ts, CAST(amount AS DOUBLE) AS amount, flagged, currency FROM valid),
nodes AS (SELECT src AS node_id FROM e UNION SELECT dst FROM e)"""
_CENTRAL = f"""{_EDGES}, ends AS (SELECT src AS node_id FROM e UNION ALL SELECT dst FROM e), central AS (SELECT node_id, count(*) / (2.0::DOUBLE * ((SELECT count(*) FROM nodes) - 1)) AS centrality FROM ends GROUP BY node_id)"""
_NAME = "regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_replace(strip_accents(coalesce(name, '')), '[^A-Za-z\\s]', '', 'g'), '\\s+', ' ', 'g'))), '\\b(" + "|".join(LEGAL_FORMS) + ")\\b', '', 'g'), '\\s+', ' ', 'g')"
_ADDRESS = "lower(regexp_replace(strip_accents(replace(replace(coalesce(address, ''), 'º', 'o'), 'ª', 'a')), '[^\\x00-\\x7F]', '', 'g'))"
for _short, _long in ADDRESS_WORDS.items():
    _ADDRESS = f"regexp_replace({_ADDRESS}, '\\b{_short}\\b', '{_long}', 'g')"
_ADDRESS = f"regexp_replace(regexp_replace({_ADDRESS}, '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')"
_JACCARD = "CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 1.0::DOUBLE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({0}, {1})) / CAST(len(list_distinct(list_concat({0}, {1}))) AS DOUBLE) END"
_TOKENS = "list_distinct(list_filter(string_split({0}, ' '), lambda x: x <> ''))"
_PAIRS = f"""feat AS (SELECT entity_id AS id, trim({_NAME}) AS name, trim({_ADDRESS}) AS address, lower(trim(dob)) AS dob, lower(trim(national_id)) AS nid, list_distinct(coalesce(account_numbers, [])) AS acc FROM entities),
tok AS (SELECT *, {_TOKENS.format('name')} AS nt, {_TOKENS.format('address')} AS ad, list_distinct(list_transform(generate_series(1, length(name) - 1), lambda i: substr(name, i, 2))) AS ng FROM feat),
cand AS (SELECT a AS a, b AS b FROM tok a JOIN tok b ON a.nid = b.nid AND a.id < b.id UNION SELECT a, b FROM tok a JOIN tok b ON a.dob = b.dob AND a.id < b.id),
sim AS (SELECT a.id AS id_a, b.id AS id_b, ({_JACCARD.format('a.nt', 'b.nt')} * 0.6::DOUBLE + CASE WHEN a.name = '' AND b.name = '' THEN 1.0::DOUBLE WHEN a.name = '' OR b.name = '' THEN 0.0::DOUBLE
WHEN length(a.name) < 2 OR length(b.name) < 2 THEN CAST(a.name = b.name AS DOUBLE) ELSE 2.0::DOUBLE * len(list_intersect(a.ng, b.ng)) / (len(a.ng) + len(b.ng)) END * 0.4::DOUBLE) * 0.35::DOUBLE
+ {_JACCARD.format('a.ad', 'b.ad')} * 0.2::DOUBLE + CAST(coalesce(a.dob = b.dob, false) AS DOUBLE) * 0.15::DOUBLE + CAST(coalesce(a.nid = b.nid, false) AS DOUBLE) * 0.2::DOUBLE
+ CASE WHEN len(a.acc) = 0 OR len(b.acc) = 0 THEN 0.0::DOUBLE ELSE {_JACCARD.format('a.acc', 'b.acc')} END * 0.1::DOUBLE AS similarity FROM cand), pairs AS (SELECT * FROM sim WHERE similarity >= 0.7)"""
_GROUPS = f"""{_PAIRS}, links AS (SELECT id_a AS x, id_b AS y FROM pairs UNION SELECT id_b, id_a FROM pairs), reach(x, y) AS (SELECT entity_id, entity_id FROM entities UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
groups AS (SELECT x AS entity_id, min(y) AS group_id FROM reach GROUP BY x)"""
_FIRST = "(min_by(nullif({0}, ''), e.entity_id) FILTER (WHERE nullif({0}, '') IS NOT NULL)) AS {0}"

_PATHS = f"""WITH RECURSIVE {_EDGES}, path AS (SELECT a.account_id AS source, a.account_id AS at, [a.account_id] AS path, 0 AS hops, 0.0::DOUBLE AS amount FROM accounts a JOIN entities x ON x.entity_id = a.entity_id WHERE {{source}}
UNION ALL SELECT p.source, f.dst, list_append(p.path, f.dst), p.hops + 1, p.amount + f.amount FROM path p JOIN {{edges}} f ON f.src = p.at AND NOT list_contains(p.path, f.dst) WHERE p.hops < {{hops}})
SELECT source, array_to_string(path, '|') AS path, hops, floor(amount * 10000 + 0.5) / 10000 AS amount FROM path WHERE hops > 0 AND (hops >= 3 OR amount >= 50000)"""
_CYCLES = f"""WITH RECURSIVE {_EDGES}, f AS (SELECT DISTINCT src, dst FROM e{{where}}), fn AS (SELECT src AS node_id FROM f UNION SELECT dst FROM f), reach(x, y) AS (SELECT src, dst FROM f UNION SELECT r.x, f.dst FROM reach r JOIN f ON f.src = r.y),
cyc AS (SELECT DISTINCT x FROM reach WHERE x = y) SELECT node_id, node_id IN (SELECT x FROM cyc) OR node_id IN (SELECT r.x FROM reach r JOIN cyc c ON c.x = r.y) AS reaches_cycle FROM fn"""

SQL = {
    "degree_centrality": f"WITH {_CENTRAL} SELECT node_id, floor(centrality * 1000000 + 0.5) / 1000000 AS centrality FROM central",
    "network_stats": f"WITH {_EDGES}, n AS (SELECT count(*) AS n FROM nodes), m AS (SELECT count(DISTINCT edge_id) AS m FROM e) SELECT n AS node_count, m AS edge_count, floor(m / CAST(CASE WHEN n > 1 THEN n * (n - 1) ELSE 1 END AS DOUBLE) * 1e6 + 0.5) / 1e6 AS density FROM n, m",
    "top_nodes": f"WITH {_CENTRAL} SELECT node_id FROM (SELECT node_id, row_number() OVER (ORDER BY centrality DESC, node_id) AS r FROM central) WHERE r <= greatest(1, CAST(floor((SELECT count(*) FROM nodes) * 0.1) AS BIGINT))",
    "layering_nodes": f"WITH {_EDGES}, p AS (SELECT a.src, a.dst, b.dst AS far FROM e a JOIN e b ON b.src = a.dst AND b.ts >= a.ts AND a.ts >= -1) SELECT src AS node_id FROM p UNION SELECT dst FROM p UNION SELECT far FROM p",
    "suspicious_paths": _PATHS.format(edges="e", source="a.account_id = (SELECT min(b.account_id) FROM accounts b JOIN entities y ON y.entity_id = b.entity_id WHERE y.pep_flag)", hops=PATH_HOPS),
    "flagged_paths": _PATHS.format(edges="(SELECT * FROM e WHERE flagged)", source="x.pep_flag", hops=5),
    "cycle_reachable": _CYCLES.format(where=""),
    "flagged_cycles": _CYCLES.format(where=" WHERE flagged"),
    "network_nodes": f"""WITH {_EDGES}, f AS (SELECT src AS node_id FROM e WHERE flagged UNION SELECT dst FROM e WHERE flagged), o AS (SELECT f.node_id, a.account_number, x.entity_id, x.name,
CASE WHEN x.risk_score >= 80 THEN 'CRITICAL' WHEN x.risk_score >= 60 THEN 'HIGH' WHEN x.risk_score >= 30 THEN 'MEDIUM' WHEN x.risk_score IS NOT NULL THEN 'LOW' END AS risk_level
FROM f JOIN accounts a ON a.account_id = f.node_id JOIN entities x ON x.entity_id = a.entity_id)
SELECT node_id, account_number AS label, 'ACCOUNT' AS node_type, risk_level FROM o UNION ALL SELECT DISTINCT entity_id, name, 'ENTITY', risk_level FROM o""",
    "network_payload": f"""WITH {_EDGES} SELECT e.edge_id, e.src AS source, e.dst AS target, e.amount, e.currency, e.currency || ' ' || CASE WHEN e.amount >= 1e6 THEN CAST(floor(e.amount / 1e6 * 100 + 0.5) / 100 AS VARCHAR) || 'M'
WHEN e.amount >= 1e3 THEN CAST(CAST(floor(e.amount / 1e3 + 0.5) AS BIGINT) AS VARCHAR) || 'K' ELSE CAST(CAST(floor(e.amount + 0.5) AS BIGINT) AS VARCHAR) END AS label, a.country_code AS source_country, b.country_code AS target_country
FROM e JOIN accounts a ON a.account_id = e.src JOIN accounts b ON b.account_id = e.dst WHERE e.flagged""",
    "er_normalize_name": f"SELECT entity_id, trim({_NAME}) AS normalized FROM entities",
    "er_normalize_address": f"SELECT entity_id, trim({_ADDRESS}) AS normalized FROM entities",
    "er_pairs": f"WITH {_PAIRS} SELECT id_a, id_b, floor(similarity * 1000000 + 0.5) / 1000000 AS similarity FROM pairs",
    "er_components": f"WITH RECURSIVE {_GROUPS} SELECT entity_id, group_id FROM groups",
    "er_network": f"WITH RECURSIVE {_GROUPS} SELECT a.entity_id, b.entity_id AS related_id FROM groups a JOIN groups b ON a.group_id = b.group_id AND a.entity_id <> b.entity_id",
    "er_merged": f"""WITH RECURSIVE {_GROUPS}, acc AS (SELECT group_id, string_agg(x, '|' ORDER BY x) AS accounts FROM (SELECT DISTINCT g.group_id, unnest(e.account_numbers) AS x FROM entities e JOIN groups g ON g.entity_id = e.entity_id) GROUP BY group_id),
m AS (SELECT g.group_id, {', '.join(_FIRST.format(c) for c in ('name', 'address', 'dob', 'national_id'))}, max(e.risk_score) AS risk_score, count(*) AS members FROM entities e JOIN groups g ON g.entity_id = e.entity_id GROUP BY g.group_id)
SELECT m.*, coalesce(acc.accounts, '') AS accounts FROM m LEFT JOIN acc ON acc.group_id = m.group_id""",
}
