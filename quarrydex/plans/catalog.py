"""Named queries over the test tables, each with the same question in DuckDB SQL.

documents are files with contents, embeddings are vectors with their label as node, lineitem is the replica table
(file l_orderkey, node l_suppkey), supplier is the node table (offline where the balance is negative), part has names and
sizes, events are activities, heartbeats and failures, pages are paths of the namespace.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import scalars as S
from ..functions.tables import beside
from ..operators import checkpoints, namespace, registry, reliability, replication, routing, search, vectors
from ..operators.cells import Cells
from ..operators.fuzzy import FuzzyNames
from ..operators.text_index import TextIndex
from ..sources import messages
from ..sources.buckets import BucketTable
from ..sources.files import exists, fingerprint, read_table, shared_folder, split_ingest
from ..streaming import discovery, elections, heartbeats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# ---- tables as the operators know them


def vector_table(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "embeddings").select(F.col("vec_id").alias("file_id"), F.col("label").alias("node_id"), "embedding")


def some_vector(s: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return [float(x) for x in read_table(s, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def node_table(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") < 0, "offline").otherwise("online").alias("status"))


def replica_rows(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_suppkey").alias("node_id"), F.col("l_returnflag").alias("content_hash"), F.col("l_shipdate").alias("last_updated"), F.col("l_quantity").alias("size"), F.col("l_partkey").alias("part_id"), F.col("l_linenumber").alias("line"))


def latest_first() -> list[Column]:
    """The order of the rows of a (file, node)."""
    return [F.desc("last_updated"), F.desc("line"), F.desc("part_id")]


def file_table(s: SparkSession, d: str) -> DataFrame:
    """The latest row of each (file, node)."""
    return registry.latest(replica_rows(s, d), ["file_id", "node_id"], latest_first())


def part_table(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "part").select(F.col("p_partkey").alias("file_id"), F.col("p_name").alias("name"), F.col("p_type").alias("content"), F.col("p_size").alias("size"), F.col("p_brand").alias("type"))


def load_table(s: SparkSession, d: str) -> DataFrame:
    """Loads made of what each supplier delivers: active queries from lines, processor and memory from means, documents from orders."""
    own = read_table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("node_id"))
    return own.agg(
        F.pmod(F.count(F.lit(1)), F.lit(17)).cast("int").alias("active_queries"),
        F.avg("l_quantity").alias("cpu_usage"),
        (F.avg("l_discount") * F.lit(1000.0)).alias("memory_usage"),
        F.count_distinct("l_orderkey").alias("document_count"),
        F.max("l_shipdate").alias("last_updated"),
    )


def score_table(s: SparkSession, d: str) -> DataFrame:
    """An affinity for two of three nodes, so that the default counts too."""
    rows = read_table(s, d, "supplier")
    return rows.where(F.col("s_nationkey") > 7).select(F.col("s_suppkey").alias("node_id"), (F.col("s_nationkey") / F.lit(25.0)).alias("score"))


def event_table(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "events").select("event_id", F.col("ts").alias("timestamp"), F.col("user_id").alias("node_id"), "user_id", "event_type")


def failure_table(s: SparkSession, d: str) -> DataFrame:
    return reliability.intervals(event_table(s, d), F.col("event_type") == "error")


def path_table(s: SparkSession, d: str) -> DataFrame:
    pages = read_table(s, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    return namespace.paths(pages.groupBy("path").agg(F.min("page_id").alias("file_id")))


#: Indexes that this session has opened, by application, table, its files and the index's name.
_INDEXES: dict[tuple[str, str, str, str], TextIndex] = {}


def _index(s: SparkSession, d: str, table: str, label: str, docs: Callable[[SparkSession, str], DataFrame], fields: list[str], **more) -> TextIndex:
    """The index of a table as it is now, in the shared folder: one that is there from an earlier session is opened, else it is built."""
    path = f"{d}/{table}.parquet"
    key = (s.sparkContext.applicationId, path, fingerprint(s, path), label)
    if key not in _INDEXES:
        folder = f"{shared_folder(s)}/{label}-index-{hashlib.sha256(repr(key[1:]).encode()).hexdigest()[:32]}"
        if exists(s, f"{folder}/terms/_SUCCESS"):  # what is written last
            _INDEXES[key] = TextIndex.open(s, folder)
        else:
            _INDEXES[key] = TextIndex.build(docs(s, d), folder, fields, **more)
    return _INDEXES[key]


def text_index(s: SparkSession, d: str) -> TextIndex:
    """The index over the texts of documents."""
    return _index(s, d, "documents", "text", lambda s, d: read_table(s, d, "documents").select(F.col("doc_id").alias("file_id"), "text", "lang"), ["text"], kind="lang")


def part_index(s: SparkSession, d: str) -> TextIndex:
    """The index over names and types of parts, with their brands as kinds."""
    return _index(s, d, "part", "part", part_table, ["name", "content"], kind="type", name="name")


def page_index(s: SparkSession, d: str) -> TextIndex:
    """The index over the addresses of pages as names."""
    return _index(s, d, "pages", "page", lambda s, d: read_table(s, d, "pages").select(F.col("page_id").alias("file_id"), F.col("url").alias("name")), ["name"], name="name")


def spanish_index(s: SparkSession, d: str) -> TextIndex:
    """The index over the texts of documents in which the Spanish ones are stemmed."""
    return _index(s, d, "documents", "spanish", lambda s, d: read_table(s, d, "documents").select(F.col("doc_id").alias("file_id"), "text", "lang"), ["text"], kind="lang", language="lang")


def vector_cells(s: SparkSession, d: str) -> Cells:
    """Embeddings by the cells of their pivots, in the shared folder."""
    path = f"{d}/embeddings.parquet"
    folder = f"{shared_folder(s)}/cells-{hashlib.sha256((path + fingerprint(s, path)).encode()).hexdigest()[:32]}"
    if not exists(s, f"{folder}/about/_SUCCESS"):  # what is written last
        return Cells.build(vector_table(s, d), folder)
    return Cells.open(s, folder)


_V = "v AS (SELECT vec_id AS file_id, label AS node_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
_COS = lambda a, b: f"list_inner_product({a}, {b}) / ((sqrt(list_inner_product({a}, {a})) + 1e-10) * (sqrt(list_inner_product({b}, {b})) + 1e-10))"
_C = """u AS (SELECT file_id, node_id, unnest(range(0, len(e))) AS pos, unnest(e) / (sqrt(list_inner_product(e, e)) + 1e-10) AS x FROM v),
m AS (SELECT node_id, pos, avg(x) AS m FROM u GROUP BY ALL),
l AS (SELECT node_id, sqrt(sum(m * m)) AS l FROM m GROUP BY ALL),
c AS (SELECT node_id, list(m / (l + 1e-10) ORDER BY pos) AS c FROM m JOIN l USING (node_id) GROUP BY node_id)"""
_NODES = "nodes AS (SELECT s_suppkey AS node_id, s_name AS name, CASE WHEN s_acctbal < 0 THEN 'offline' ELSE 'online' END AS status FROM supplier)"
_FILES = """files AS (SELECT * FROM (SELECT l_orderkey AS file_id, l_suppkey AS node_id, l_returnflag AS content_hash, l_shipdate AS last_updated, l_quantity AS size,
  row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) AS nth FROM lineitem) WHERE nth = 1)"""
_LOADS = """loads AS (SELECT l_suppkey AS node_id, CAST(count(*) % 17 AS INTEGER) AS active_queries, avg(l_quantity) AS cpu_usage, avg(l_discount) * 1000 AS memory_usage,
  count(DISTINCT l_orderkey) AS document_count, max(l_shipdate) AS last_updated FROM lineitem GROUP BY ALL),
scored AS (SELECT n.node_id, n.status, coalesce(active_queries, 0) AS active_queries, coalesce(document_count, 0) AS document_count, last_updated,
  0.3 * least(coalesce(active_queries, 0) / 10.0, 1.0) + 0.4 * coalesce(cpu_usage, 0) / 100 + 0.3 * coalesce(memory_usage, 0) / 100 AS load,
  s_nationkey / 25.0 AS own, s_nationkey > 7 AS has FROM nodes n LEFT JOIN loads USING (node_id) JOIN supplier ON s_suppkey = n.node_id)"""
_FAIL = """e AS (SELECT event_id, ts, user_id AS node_id, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
f AS (SELECT node_id, ts, nxt AS rec, (epoch_us(nxt) - epoch_us(ts)) / 1e6 AS down FROM e WHERE event_type = 'error')"""
_METRICS = """g AS (SELECT *, (epoch_us(lead(ts) OVER (PARTITION BY node_id ORDER BY ts)) - epoch_us(rec)) / 1e6 AS gap FROM f WHERE rec IS NOT NULL),
a AS (SELECT node_id, count(*) AS failures, avg(down) AS r, coalesce(avg(gap), 0) AS u FROM g GROUP BY node_id),
metrics AS (SELECT node_id, failures, round(r, 6) AS mttr, round(u, 6) AS mttf, round(r + u, 6) AS mtbf, CASE WHEN r + u > 0 THEN round(u / (r + u), 6) ELSE 1.0 END AS availability FROM a)"""
_PATHS = r"""pg AS (SELECT min(page_id) AS file_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages GROUP BY 2),
pp AS (SELECT file_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM pg),
pe AS (SELECT file_id, p, unnest(range(1, len(p) + 1)) AS depth FROM pp WHERE len(p) > 0),
tree AS (SELECT '/' || array_to_string(p[1:depth], '/') AS path, '/' || array_to_string(p[1:depth - 1], '/') AS parent_path, p[depth] AS name, CAST(depth AS INTEGER) AS depth,
  bool_or(depth = len(p)) AS is_file, min(CASE WHEN depth = len(p) THEN file_id END) AS file_id FROM pe GROUP BY 1, 2, 3, 4)"""


def _bm25(table: str, key: str, column: str, terms: list[str], name: str = "") -> str:
    idf = lambda k: f"ln(1e0 + (n - df{k} + 0.5e0) / (df{k} + 0.5e0)) * tf{k} * 2.5e0 / (tf{k} + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))"
    return f"""t{name} AS (SELECT {key} AS file_id, list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM {table}),
k{name} AS (SELECT file_id, len(t) AS dl, {", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{k}" for k, w in enumerate(terms))} FROM t{name}),
g{name} AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(f"count(*) FILTER (WHERE tf{k} > 0) AS df{k}" for k in range(len(terms)))} FROM k{name}),
s{name} AS (SELECT file_id, {" + ".join(idf(k) for k in range(len(terms)))} AS score FROM k{name}, g{name} WHERE {" OR ".join(f"tf{k} > 0" for k in range(len(terms)))})"""


# ---- vectors


@query(f"WITH {_V} SELECT file_id, node_id, round({_COS('e', 'q')}, 6) AS score FROM v, q ORDER BY score DESC, file_id LIMIT 10")
def knn_cosine_topk(s, d):
    return vectors.knn(vector_table(s, d), some_vector(s, d), 10)


@query(f"WITH {_V} SELECT file_id, node_id, round({_COS('e', 'q')}, 6) AS score FROM v, q WHERE node_id IN (1, 3, 5) ORDER BY score DESC, file_id LIMIT 10")
def knn_node_filter(s, d):
    return vectors.knn(vector_table(s, d), some_vector(s, d), 10, [1, 3, 5])


@query(f"WITH {_V} SELECT b.file_id AS query_id, a.file_id, round({_COS('a.e', 'b.e')}, 6) AS score FROM v a, v b WHERE b.file_id % 50 = 0")
def batch_similarity(s, d):
    queries = read_table(s, d, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.batch_similarity(vector_table(s, d), queries)


@query(f"WITH {_V}, {_C} SELECT node_id, pos, round(m / (l + 1e-10), 6) AS value FROM m JOIN l USING (node_id)")
def node_centroids(s, d):
    return vectors.centroid_parts(vector_table(s, d)).select("node_id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


@query(f"WITH {_V}, {_C} SELECT node_id, round({_COS('c', 'q')}, 6) AS score FROM c, q ORDER BY score DESC, node_id LIMIT 3")
def route_nodes_for_query(s, d):
    return vectors.route(vector_table(s, d), some_vector(s, d), 3)


_ROUTED = f"""{_V}, {_C}, top AS (SELECT node_id FROM (SELECT node_id, round({_COS('c', 'q')}, 6) AS score FROM c, q) ORDER BY score DESC, node_id LIMIT 3),
best AS (SELECT * FROM (SELECT file_id, node_id, {_COS('e', 'q')} AS score, row_number() OVER (PARTITION BY node_id ORDER BY {_COS('e', 'q')} DESC, file_id) AS nth FROM v JOIN top USING (node_id), q) WHERE nth <= 20),
routed AS (SELECT file_id, node_id, round(score, 6) AS score FROM best ORDER BY score DESC, file_id LIMIT 10)"""


@query(f"WITH {_ROUTED} SELECT * FROM routed")
def routed_search(s, d):
    return vectors.routed_search(vector_table(s, d), some_vector(s, d), 3, 10)


@query(f"""WITH {_ROUTED}, exact AS (SELECT file_id, round({_COS('e', 'q')}, 6) AS score FROM v, q ORDER BY score DESC, file_id LIMIT 10)
SELECT 10 AS k, count(*) AS found, round(count(*) / 10, 6) AS recall FROM exact WHERE file_id IN (SELECT file_id FROM routed)""")
def routing_recall(s, d):
    return vectors.routing_recall(vector_table(s, d), some_vector(s, d), 3, 10)


@query(f"""WITH {_V}, {_C} SELECT file_id, CAST(node_id AS VARCHAR) AS node_id, score, CAST(nth AS INTEGER) AS nth FROM (
SELECT v.file_id, c.node_id, round({_COS('e', 'c')}, 6) AS score, row_number() OVER (PARTITION BY v.file_id ORDER BY round({_COS('e', 'c')}, 6) DESC, CAST(c.node_id AS VARCHAR)) AS nth
FROM v JOIN c ON v.node_id <> c.node_id) WHERE nth <= 2""")
def replica_nodes_by_affinity(s, d):
    return vectors.replica_nodes(vector_table(s, d), 2)


@query("SELECT label AS node_id, count(*) AS document_count FROM embeddings GROUP BY ALL")
def index_location_stats(s, d):
    return vectors.location_stats(vector_table(s, d))


@query(f"""WITH {_V}, p AS (SELECT a.file_id AS query_id, b.file_id, b.node_id, round({_COS('b.e', 'a.e')}, 6) AS score FROM v a JOIN v b ON a.file_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, file_id, node_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id) AS rank FROM p) WHERE rank <= 10""")
def knn_by_cells(s, d):
    queries = vector_table(s, d).where(F.col("file_id") % 50 == 0).select(F.col("file_id").alias("query_id"), "embedding")
    return vector_cells(s, d).neighbours(queries, 10)


@query(f"WITH {_V}, {_C}, {_NODES} SELECT c.node_id, round({_COS('c', 'q')}, 6) AS score FROM c JOIN q ON true JOIN nodes ON nodes.node_id = c.node_id WHERE status = 'online' ORDER BY score DESC, c.node_id LIMIT 4")
def select_nodes_by_centroids(s, d):
    affinity = vectors.route(vector_table(s, d), some_vector(s, d), 1 << 20)
    return routing.select_nodes(node_table(s, d), load_table(s, d), affinity, "semantic", 4)


# ---- text


@query(r"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, CAST(count(*) AS BIGINT) AS cf FROM t GROUP BY term""")
def text_postings_stats(s, d):
    return search.postings_stats(read_table(s, d, "documents"), "text", "doc_id")


@query(f"WITH {_bm25('documents', 'doc_id', 'text', ['the', 'moron', 'erand'])} SELECT file_id, round(score, 6) AS score FROM s ORDER BY score DESC, file_id LIMIT 20")
def bm25_search(s, d):
    return text_index(s, d).search("The moron erand", 20, {"text": 1.0})


@query(f"WITH {_bm25('documents', 'doc_id', 'text', ['des', 'und'])} SELECT file_id, round(score, 6) AS score FROM s WHERE file_id IN (SELECT doc_id FROM documents WHERE lang = 'fr') ORDER BY score DESC, file_id LIMIT 20")
def bm25_search_typed(s, d):
    return text_index(s, d).search("des und", 20, {"text": 1.0}, "fr")


@query(f"WITH {_bm25('documents', 'doc_id', 'text', ['der', 'que'])} SELECT file_id, round(score, 6) AS score FROM s ORDER BY score DESC, file_id LIMIT 20")
def bm25_search_without_index(s, d):
    return search.text_search(read_table(s, d, "documents"), "der que", 20, "text", "doc_id")


@query(f"""WITH {_bm25('part', 'p_partkey', 'p_name', ['steel', 'large'], 'n')}, {_bm25('part', 'p_partkey', 'p_type', ['steel', 'large'], 'c')},
b AS (SELECT file_id, score * 10 AS score FROM sn UNION ALL SELECT file_id, score FROM sc)
SELECT file_id, round(sum(score), 6) AS score FROM b GROUP BY file_id ORDER BY score DESC, file_id LIMIT 50""")
def weighted_name_content_search(s, d):
    return part_index(s, d).search("steel LARGE", 50)


_FALLBACK = "SELECT p_partkey AS file_id, 0.0 AS score, 'name' AS matched FROM part WHERE contains(lower(p_name), 'ee') ORDER BY file_id LIMIT 50"


@query(f"""WITH {_bm25('part', 'p_partkey', 'p_name', ['steel'], 'n')}, {_bm25('part', 'p_partkey', 'p_type', ['steel'], 'c')},
b AS (SELECT file_id, score * 10 AS score FROM sn UNION ALL SELECT file_id, score FROM sc), f AS ({_FALLBACK}),
t AS (SELECT file_id, round(sum(score), 6) AS score, 'text' AS matched FROM b GROUP BY file_id ORDER BY score DESC, file_id LIMIT 50)
SELECT 'steel' AS asked, * FROM t UNION ALL SELECT 'ee' AS asked, * FROM f""")
def search_with_fallback(s, d):
    # one query that a text matches, one that only names do
    found = [search.indexed_search(part_index(s, d), q, None, 50).select(F.lit(q).alias("asked"), "file_id", F.col("score").cast("double").alias("score"), "matched") for q in ("steel", "ee")]
    return found[0].union(found[1])


@query(f"""WITH {_FILES}, h AS (SELECT o_orderkey AS file_id, o_totalprice AS score, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders)
SELECT CAST(h.nth AS INTEGER) AS nth, h.file_id, score, node_id FROM h JOIN files ON files.file_id = h.file_id WHERE h.nth <= 25 ORDER BY 1, node_id""")
def search_hits_with_replicas(s, d):
    hits = read_table(s, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_totalprice").alias("score")).orderBy(F.desc("score"), "file_id").limit(25)
    return search.with_files(hits, file_table(s, d), 25).select("nth", "file_id", "score", "node_id")


_STEMS = {
    "ment": "mente menteado mentear mentearas menteas menteases mentees menteiera menteías mentieran".split(),
    "que": "que queado quean quear quearas queas queases quees queiera queos queosado queosar queosas queosases queoses queosiera queí queíado queíar queías queíes queó queóado queóar queóas queóes".split(),
}


def _stemmed_bm25() -> str:
    """BM25 over the words of documents, those of Spanish ones by their stems: the words of two stems are listed."""
    listed = " ".join(f"WHEN lang = 'es' AND w IN ({', '.join(repr(x) for x in own)}) THEN '{stem}'" for stem, own in _STEMS.items())
    stems = f"w AS (SELECT doc_id, lang, regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+') AS ws FROM documents), stemmed AS (SELECT doc_id, (SELECT string_agg(CASE {listed} ELSE w END, ' ') FROM (SELECT unnest(ws) AS w)) AS text FROM w)"
    return f"{stems}, {_bm25('stemmed', 'doc_id', 'text', list(_STEMS))}"


@query(f"WITH {_stemmed_bm25()} SELECT file_id, round(score, 6) AS score FROM s ORDER BY score DESC, file_id LIMIT 20")
def spanish_search(s, d):
    return spanish_index(s, d).search("Menteado queóar", 20, {"text": 1.0}, language="spanish")


@query("SELECT page_id AS file_id, url AS name FROM pages WHERE contains(lower(url), '/en/6') ORDER BY file_id LIMIT 50")
def name_substring_search(s, d):
    return page_index(s, d).names_containing("/EN/6", 50)


@query(r"SELECT page_id AS file_id, url AS name FROM pages WHERE regexp_matches(lower(url), '^https?:.*th.*\.org/.*[0-5]$', 's')")
def name_pattern_search(s, d):
    return page_index(s, d).names_like("http*:*TH*.org/*[0-5]")


@query(f"""WITH {_bm25('part', 'p_partkey', 'p_name', ['bolt'], 'n')}, {_bm25('part', 'p_partkey', 'p_type', ['bolt'], 'c')},
b AS (SELECT file_id, score * 10 AS score FROM sn UNION ALL SELECT file_id, score FROM sc),
t AS (SELECT file_id, round(sum(score), 6) AS score, 'text' AS matched FROM b WHERE file_id IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#4') GROUP BY file_id ORDER BY score DESC, file_id LIMIT 50),
f AS (SELECT p_partkey AS file_id, CAST(0 AS DOUBLE) AS score, 'name' AS matched FROM part WHERE contains(lower(p_name), 'izm') AND p_brand = 'Brand#4' ORDER BY file_id LIMIT 50)
SELECT 'bolt' AS asked, * FROM t UNION ALL SELECT 'izm' AS asked, * FROM f""")
def typed_search_with_fallback(s, d):
    # a word of names, then a part of a word
    found = [search.indexed_search(part_index(s, d), q, "Brand#4", 50).select(F.lit(q).alias("asked"), "file_id", F.col("score").cast("double").alias("score"), "matched") for q in ("bolt", "izm")]
    return found[0].union(found[1])


@query("SELECT p_partkey AS file_id, p_name AS name FROM part WHERE contains(lower(p_name), 'ee') ORDER BY file_id LIMIT 50")
def regex_name_fallback(s, d):
    return part_index(s, d).names_containing("EE", 50)


@query(f"""WITH {_bm25('part', 'p_partkey', 'p_name', ['small'], 'n')}, h AS (SELECT file_id, round(score, 6) AS score FROM sn ORDER BY score DESC, file_id LIMIT 10)
SELECT h.file_id, h.score, l_suppkey AS node_id, count(*) AS replicas FROM h JOIN lineitem ON l_partkey = h.file_id GROUP BY ALL""")
def search_result_files(s, d):
    hits = search.text_search(part_table(s, d), "small", 10, "name")
    held = read_table(s, d, "lineitem").select(F.col("l_partkey").alias("file_id"), F.col("l_suppkey").alias("node_id"))
    return search.with_files(hits, held).groupBy("file_id", "score", "node_id").agg(F.count(F.lit(1)).alias("replicas"))


@query(f"""WITH {_NODES}, {_bm25('part', 'p_partkey', 'p_name', ['small'], 'n')}, h AS (SELECT file_id, round(score, 6) AS score FROM sn ORDER BY score DESC, file_id LIMIT 3)
SELECT node_id, name, status FROM nodes WHERE status = 'online' AND node_id IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT file_id FROM h))""")
def nodes_available_for_hits(s, d):
    hits = search.text_search(part_table(s, d), "small", 3, "name")
    held = read_table(s, d, "lineitem").select(F.col("l_partkey").alias("file_id"), F.col("l_suppkey").alias("node_id"))
    return search.nodes_of(hits, held, node_table(s, d).where("status = 'online'"))


@query(r"""WITH w AS (SELECT p_partkey, p_name, unnest(list_filter(regexp_split_to_array(lower(p_name), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM part)
SELECT p_partkey AS file_id, p_name AS name, CAST(min(levenshtein(t, 'gren')) AS INTEGER) AS distance FROM w GROUP BY ALL HAVING min(levenshtein(t, 'gren')) <= 1""")
def fuzzy_name_search(s, d):
    return search.fuzzy_names(part_table(s, d), "gren", 1)


@query(r"""WITH w AS (SELECT p_partkey, p_name, unnest(list_filter(regexp_split_to_array(lower(p_name), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM part)
SELECT p_partkey AS file_id, p_name AS name, CAST(min(levenshtein(t, 'gizno')) AS INTEGER) AS distance FROM w GROUP BY ALL HAVING min(levenshtein(t, 'gizno')) <= 2""")
def fuzzy_index_search(s, d):
    path = f"{shared_folder(s)}/fuzzy-{uuid.uuid4().hex}"
    return FuzzyNames.build(part_table(s, d), path).search("Gizno", 2)


@query(f"""WITH brand AS (SELECT * FROM part WHERE p_brand = 'Brand#7'), {_bm25('brand', 'p_partkey', 'p_name', ['bolt', 'small'], 'n')}, {_bm25('brand', 'p_partkey', 'p_type', ['bolt', 'small'], 'c')},
b AS (SELECT file_id, score * 10 AS score FROM sn UNION ALL SELECT file_id, score FROM sc), h AS (SELECT file_id, round(sum(score), 6) AS score FROM b GROUP BY file_id ORDER BY score DESC, file_id LIMIT 20)
SELECT h.file_id, score, l_suppkey AS node_id FROM h JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = h.file_id""")
def engine_search(s, d):
    # each part is a file on every node that delivers it
    held = read_table(s, d, "lineitem").select(F.col("l_partkey").alias("file_id"), F.col("l_suppkey").alias("node_id"))
    files = part_table(s, d).drop("content").hint("shuffle_hash").join(held, "file_id", "left")  # rows of lineitem aren't sorted for it
    engine = Engine(s, tables={"files": files, "contents": part_table(s, d).select("file_id", "content")})
    return engine.result_files(engine.search("BOLT small", "Brand#7", 20)).where("node_id is not null").select("file_id", "score", "node_id").distinct()


@query(f"WITH {_bm25('documents', 'doc_id', 'text', ['der', 'erand'])} SELECT file_id, round(score, 6) AS score FROM s WHERE file_id IN (SELECT doc_id FROM documents WHERE n_chars BETWEEN 200 AND 900) ORDER BY score DESC, file_id LIMIT 15")
def bm25_search_filtered(s, d):
    return search.text_search(read_table(s, d, "documents"), "der erand", 15, "text", "doc_id", where=F.col("n_chars").between(200, 900))


@query("SELECT p_partkey AS file_id, p_size AS size FROM part WHERE p_size BETWEEN 10 AND 20")
def size_range_filter(s, d):
    return search.in_ranges(part_table(s, d), (10, 20)).select("file_id", "size")


# ---- index statistics and files


@query("SELECT lang AS type, count(*) AS files FROM documents GROUP BY lang")
def files_by_type(s, d):
    return registry.files_by_type(read_table(s, d, "documents").withColumnRenamed("lang", "type"))


@query(f"""WITH {_NODES}, f AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS total_files, CAST(sum(q) AS DOUBLE) AS total_size, count(*) FILTER (WHERE n > 1) AS duplicate_files,
(SELECT count(*) FILTER (WHERE status = 'online') FROM nodes) AS active_nodes, (SELECT count(*) FROM nodes) AS total_nodes FROM f""")
def index_stats(s, d):
    return registry.index_stats(replica_rows(s, d), node_table(s, d))


@query("SELECT l_orderkey AS file_id, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_files(s, d):
    return registry.duplicates(replica_rows(s, d))


@query("SELECT sha256(coalesce(text, '')) AS content_hash, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1")
def content_hash_duplicates(s, d):
    docs = read_table(s, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"))
    return registry.duplicates(docs, "content_hash")


@query(f"WITH {_NODES} SELECT node_id, name, status FROM nodes WHERE node_id IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey = 7)")
def nodes_with_file(s, d):
    return registry.nodes_with_file(replica_rows(s, d), node_table(s, d), 7)


@query(f"WITH {_NODES} SELECT node_id FROM nodes WHERE status = 'online' AND node_id IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey = 7) ORDER BY node_id LIMIT 1")
def download_source(s, d):
    return registry.download_node(replica_rows(s, d), node_table(s, d), 7)


@query("""SELECT l_orderkey AS file_id, l_suppkey AS node_id, strftime(l_shipdate, '%Y-%m-%d') AS updated, l_returnflag AS content_hash FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) = 1""")
def upsert_latest_file(s, d):
    return file_table(s, d).select("file_id", "node_id", F.date_format("last_updated", "yyyy-MM-dd").alias("updated"), "content_hash")


@query("SELECT doc_id AS file_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_contents(s, d):
    return registry.orphan_contents(read_table(s, d, "documents").select(F.col("doc_id").alias("file_id")), read_table(s, d, "labels").select(F.col("doc_id").alias("file_id")))


@query("""WITH o AS (SELECT o_orderkey AS file_id FROM orders), l AS (SELECT DISTINCT l_orderkey AS file_id FROM lineitem)
SELECT coalesce(o.file_id, l.file_id) AS file_id, CASE WHEN o.file_id IS NULL THEN 'add' WHEN l.file_id IS NULL THEN 'delete' ELSE 'keep' END AS action FROM o FULL JOIN l ON o.file_id = l.file_id""")
def stale_files_sync(s, d):
    stored = read_table(s, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.lit("x").alias("content_hash"))
    found = read_table(s, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.lit("x").alias("content_hash")).distinct()
    return registry.sync_directory(stored, found)


# ---- replication


@query(f"WITH {_FILES} SELECT file_id, count(*) AS holders, string_agg(node_id || ':' || content_hash, ',' ORDER BY node_id) AS versions FROM files GROUP BY file_id")
def file_versions(s, d):
    rows = replication.versions(file_table(s, d))
    return rows.select("file_id", F.size("versions").cast("bigint").alias("holders"), F.array_join(F.transform("versions", lambda v: F.concat(v["node_id"].cast("string"), F.lit(":"), v["content_hash"])), ",").alias("versions"))


@query(f"WITH {_FILES} SELECT file_id, count(*) AS holders FROM files GROUP BY file_id HAVING count(DISTINCT nullif(content_hash, '')) > 1")
def conflict_files(s, d):
    return replication.conflicts(file_table(s, d))


_CANON = "canon AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY last_updated DESC NULLS LAST, node_id) AS k FROM files) WHERE k = 1)"


@query(f"WITH {_FILES}, {_CANON} SELECT file_id, node_id, content_hash, strftime(last_updated, '%Y-%m-%d') AS updated FROM canon")
def canonical_versions_lww(s, d):
    return replication.canonical(file_table(s, d)).select("file_id", "node_id", "content_hash", F.date_format("last_updated", "yyyy-MM-dd").alias("updated"))


@query(f"""WITH {_FILES}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY last_updated NULLS FIRST, node_id) AS k FROM files) WHERE k = 1)
SELECT file_id, node_id, content_hash FROM first""")
def canonical_versions_first(s, d):
    return replication.canonical(file_table(s, d), "first_write_wins").select("file_id", "node_id", "content_hash")


@query(f"""WITH {_NODES}, {_FILES}, {_CANON} SELECT f.file_id, f.node_id, c.node_id AS source_node, c.content_hash AS canonical_hash FROM files f JOIN canon c ON c.file_id = f.file_id
JOIN nodes n ON n.node_id = f.node_id WHERE f.content_hash <> c.content_hash AND n.status = 'online'""")
def outdated_replicas(s, d):
    return replication.outdated(file_table(s, d), node_table(s, d))


_STATUS = """c AS (SELECT file_id, count(*) AS copies FROM files GROUP BY ALL)
SELECT count(*) AS unique_files, CAST(sum(copies) AS BIGINT) AS total_replicas, count(*) FILTER (WHERE copies >= 2) AS fully_replicated,
count(*) FILTER (WHERE copies < 2) AS under_replicated, round(100.0 * count(*) FILTER (WHERE copies >= 2) / count(*), 6) AS coverage_percent FROM c"""


@query("""WITH o AS (SELECT p_partkey AS file_id, p_name AS name, p_size AS size FROM part WHERE p_partkey % 3 <> 0),
n AS (SELECT p_partkey AS file_id, p_name AS name, p_size + 100 AS size FROM part WHERE p_partkey % 250 < 2)
SELECT * FROM o WHERE file_id NOT IN (SELECT file_id FROM n) AND file_id % 500 <> 7 UNION ALL SELECT * FROM n""")
def bucketed_upsert(s, d):
    files = part_table(s, d).select("file_id", "name", "size")
    table = BucketTable.create(files.where("file_id % 3 <> 0"), f"{shared_folder(s)}/files-{uuid.uuid4().hex}", ["file_id"], 256)
    newer = table.upsert(files.where("file_id % 250 < 2").withColumn("size", F.col("size") + 100))
    return newer.delete(files.where("file_id % 500 = 7")).read()


@query(f"""WITH {_FILES}, b AS (SELECT * REPLACE (CASE WHEN file_id % 97 = 5 THEN content_hash || 'x' ELSE content_hash END AS content_hash) FROM files WHERE file_id % 101 <> 3)
SELECT CAST(coalesce(files.node_id, b.node_id) AS VARCHAR) AS node_id, CAST(coalesce(files.file_id, b.file_id) AS VARCHAR) AS file_id,
  CASE WHEN b.file_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM files LEFT JOIN b ON b.file_id = files.file_id AND b.node_id = files.node_id WHERE b.file_id IS NULL OR b.content_hash <> files.content_hash""")
def checkpoint_differences(s, d):
    files = replica_rows(s, d)
    later = files.where("file_id % 101 <> 3").withColumn("content_hash", F.when(F.col("file_id") % 97 == 5, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")))
    paths = [f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}" for name in ("before", "after")]
    for rows, path in zip((files, later), paths):
        checkpoints.store(rows, path, latest_first())
    return checkpoints.differences(s, *paths)


@query(f"WITH {_FILES}, {_STATUS}")
def replication_status(s, d):
    return replication.replication_status(file_table(s, d))


@query(f"""WITH {_NODES}, {_FILES}, c AS (SELECT file_id, count(*) FILTER (WHERE status = 'online') AS holders FROM files LEFT JOIN nodes USING (node_id) GROUP BY file_id)
SELECT file_id, holders, 2 - holders AS missing FROM c WHERE holders < 2""")
def under_replicated_files(s, d):
    return replication.under_replicated(replica_rows(s, d), node_table(s, d)).select("file_id", "holders", F.col("missing").cast("bigint").alias("missing"))


@query(f"""WITH {_NODES} SELECT file_id, node_id, CAST(nth AS INTEGER) AS nth FROM (
SELECT p_partkey AS file_id, node_id, row_number() OVER (PARTITION BY p_partkey ORDER BY md5(p_partkey || ':' || node_id), node_id) AS nth FROM part, nodes WHERE status = 'online') WHERE nth <= 2""")
def replica_plan_rendezvous(s, d):
    return replication.rendezvous(part_table(s, d), node_table(s, d))


_U = lambda child: f"(('0x' || substr(md5(file_id || ':' || turn || ':' || {child}), 1, 8))::BIGINT + 0.5) / 4294967296.0"


@query(f"""WITH {_NODES}, o AS (SELECT node_id, md5(CAST(node_id AS VARCHAR)) AS h FROM nodes WHERE status = 'online'),
a AS (SELECT substr(h, 1, 1) AS c, count(*) AS w FROM o GROUP BY 1), b AS (SELECT substr(h, 1, 1) AS p, substr(h, 1, 2) AS c, count(*) AS w FROM o GROUP BY 1, 2),
t AS (SELECT p_partkey AS file_id, turn FROM part, (SELECT unnest(range(1, 9)) AS turn)),
x AS (SELECT file_id, turn, c FROM t, a QUALIFY row_number() OVER (PARTITION BY file_id, turn ORDER BY ln({_U('c')}) / w DESC, c DESC) = 1),
y AS (SELECT file_id, turn, b.c FROM x JOIN b ON b.p = x.c QUALIFY row_number() OVER (PARTITION BY file_id, turn ORDER BY ln({_U('b.c')}) / w DESC, b.c DESC) = 1),
z AS (SELECT file_id, turn, node_id FROM y JOIN o ON substr(h, 1, 2) = y.c QUALIFY row_number() OVER (PARTITION BY file_id, turn ORDER BY ln({_U('node_id')}) DESC, node_id DESC) = 1),
d AS (SELECT file_id, node_id, min(turn) AS turn FROM z GROUP BY ALL),
n AS (SELECT file_id, node_id, row_number() OVER (PARTITION BY file_id ORDER BY turn) AS nth FROM d)
SELECT file_id, node_id, CAST(nth AS INTEGER) AS nth FROM n WHERE nth <= 2""")
def replica_plan_tree(s, d):
    return replication.placed(part_table(s, d), node_table(s, d))


@query(f"""WITH {_NODES}, {_FILES}, h AS (SELECT file_id, status FROM files JOIN nodes USING (node_id))
SELECT count(*) AS checked, count(*) FILTER (WHERE file_id IN (SELECT file_id FROM h WHERE status = 'online')) AS recoverable FROM h WHERE status = 'offline'""")
def offline_files_recoverable(s, d):
    return replication.recoverable(file_table(s, d), node_table(s, d))


@query(f"""WITH {_NODES}, {_FILES}, {_CANON}, x AS (SELECT count(*) AS n FROM (SELECT file_id FROM files GROUP BY file_id HAVING count(DISTINCT content_hash) > 1))
SELECT (SELECT count(DISTINCT file_id) FROM files) AS files_checked, (SELECT n FROM x) AS conflicts,
(SELECT count(*) FROM files f JOIN canon c ON c.file_id = f.file_id JOIN nodes n ON n.node_id = f.node_id WHERE f.content_hash <> c.content_hash AND n.status = 'online') AS updates""")
def synchronise_report(s, d):
    return replication.synchronise(file_table(s, d), node_table(s, d))


# ---- routing


@query(f"WITH {_NODES}, {_LOADS} SELECT node_id, round(load, 6) AS load FROM scored")
def load_score_per_node(s, d):
    return routing.with_loads(node_table(s, d).select("node_id"), load_table(s, d)).select("node_id", F.round("load", 6).alias("load"))


@query(f"""WITH {_NODES}, {_LOADS} SELECT node_id, round(0.6 * CASE WHEN has THEN own ELSE 0.5 END + 0.4 * CASE WHEN epoch_us(TIMESTAMP '1998-08-01') - epoch_us(last_updated) > 30000000 THEN 0.5 ELSE 1 - load END, 6) AS score
FROM scored WHERE status = 'online' ORDER BY score DESC, node_id LIMIT 5""")
def select_nodes_weighted(s, d):
    return routing.select_nodes(node_table(s, d), load_table(s, d), score_table(s, d), "weighted", 5, now=F.lit("1998-08-01 00:00:00"))


@query(f"WITH {_NODES}, {_LOADS} SELECT node_id, CAST(-active_queries AS DOUBLE) AS score FROM scored WHERE status = 'online' ORDER BY score DESC, node_id LIMIT 5")
def select_nodes_least_connections(s, d):
    return routing.select_nodes(node_table(s, d), load_table(s, d), None, "least_connections", 5)


@query(f"""WITH {_NODES}, r AS (SELECT node_id, row_number() OVER (ORDER BY node_id) AS i, count(*) OVER () AS n FROM nodes WHERE status = 'online')
SELECT node_id, CAST(-((i - 2 + n) % n) AS DOUBLE) AS score FROM r ORDER BY score DESC LIMIT 5""")
def select_nodes_round_robin(s, d):
    return routing.select_nodes(node_table(s, d), load_table(s, d), None, "round_robin", 5)


@query(f"WITH {_NODES}, {_LOADS} SELECT node_id, round(own, 6) AS score FROM scored WHERE status = 'online' AND has ORDER BY score DESC, node_id LIMIT 5")
def select_nodes_semantic(s, d):
    return routing.select_nodes(node_table(s, d), load_table(s, d), score_table(s, d), "semantic", 5)


@query(f"""WITH {_NODES}, {_LOADS} SELECT node_id, round(0.4 * CASE WHEN has THEN own ELSE 0.5 END + 0.4 * (1 - load) + 0.2 * (1 - document_count / (SELECT max(document_count) FROM loads)), 6) AS score
FROM scored WHERE status = 'online' ORDER BY score DESC, node_id LIMIT 1""")
def place_document(s, d):
    return routing.place_document(node_table(s, d), load_table(s, d), score_table(s, d))


@query("""WITH e AS (SELECT event_id, user_id AS node_id, sum(CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, node_id, CAST(s - least(0, min(s) OVER (PARTITION BY node_id ORDER BY event_id_order)) AS BIGINT) AS active_queries
FROM (SELECT e.*, row_number() OVER (PARTITION BY node_id ORDER BY ts, event_id) AS event_id_order FROM e JOIN (SELECT event_id AS id, ts FROM events) t ON t.id = e.event_id)""")
def active_query_counts(s, d):
    events = event_table(s, d).withColumn("delta", F.when(F.col("event_type") == "purchase", -1).otherwise(1))
    return routing.active_queries(events, ["timestamp", "event_id"]).select("event_id", "node_id", "active_queries")


@query(f"""WITH {_NODES}, {_LOADS} SELECT count(*) AS nodes, round(avg(0.3 * least(active_queries / 10.0, 1.0) + 0.4 * cpu_usage / 100 + 0.3 * memory_usage / 100), 6) AS mean_load, CAST(sum(active_queries) AS BIGINT) AS active_queries FROM loads""")
def load_totals(s, d):
    return routing.load_totals(load_table(s, d))


# ---- reliability, heartbeats, leaders


@query(f"WITH {_FAIL}, {_METRICS} SELECT * FROM metrics")
def node_metrics_mttr_mttf(s, d):
    return reliability.node_metrics(failure_table(s, d))


@query(f"""WITH {_FAIL}, {_METRICS.replace('WHERE rec IS NOT NULL', "WHERE rec IS NOT NULL AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 3 DAY")} SELECT node_id, failures, round(mttr, 3) AS mttr, round(mttf, 3) AS mttf, round(mtbf, 3) AS mtbf, round(availability, 3) AS availability FROM metrics""")
def node_metrics_of_three_days(s, d):
    own = reliability.node_metrics(failure_table(s, d), F.lit("2024-01-20").cast("timestamp_ntz"), 3)
    return own.select("node_id", "failures", *[F.round(c, 3).alias(c) for c in ("mttr", "mttf", "mtbf", "availability")])


@query(f"""WITH {_FAIL}, {_METRICS}, o AS (SELECT DISTINCT user_id AS node_id FROM events)
SELECT count(*) AS nodes, round(avg(mttr), 6) AS mttr, round(avg(mtbf), 6) AS mtbf, round(avg(coalesce(availability, 1.0)), 6) AS availability FROM o LEFT JOIN metrics USING (node_id)""")
def system_reliability(s, d):
    nodes = read_table(s, d, "events").select(F.col("user_id").alias("node_id"), F.lit("online").alias("status")).distinct()
    return reliability.system_metrics(failure_table(s, d), nodes)


@query(f"WITH {_FAIL} SELECT node_id, epoch_us(max(ts)) AS failed_us FROM f WHERE rec IS NULL GROUP BY node_id")
def open_failures_latest(s, d):
    return reliability.open_failures(failure_table(s, d)).select("node_id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("failed_us"))


@query("""WITH e AS (SELECT user_id AS node_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events)
SELECT node_id, epoch_us(ts) AS last_us, round((epoch_us(nxt) - epoch_us(ts)) / 1e6, 6) AS gap_seconds FROM e WHERE epoch_us(nxt) - epoch_us(ts) > 21600000000""")
def heartbeat_outages(s, d):
    return heartbeats.outages(event_table(s, d), 21_600).select("node_id", F.unix_micros(F.col("last_seen").cast("timestamp")).alias("last_us"), F.round("gap_seconds", 6).alias("gap_seconds"))


@query("""WITH e AS (SELECT user_id AS node_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prv FROM events),
g AS (SELECT node_id, ts, sum(CASE WHEN prv IS NULL OR epoch_us(ts) - epoch_us(prv) > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY node_id ORDER BY ts) AS k FROM e)
SELECT node_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS announcements FROM g GROUP BY node_id, k""")
def discovery_sessions(s, d):
    rows = event_table(s, d).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return discovery.sessions(rows, 21_600).select("node_id", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "announcements")


@query("""WITH l AS (SELECT user_id AS node_id, max(ts) AS seen FROM events GROUP BY ALL), n AS (SELECT max(ts) AS now FROM events)
SELECT node_id, CASE WHEN epoch_us(now) - epoch_us(seen) > 86400000000 THEN 'offline' ELSE 'online' END AS status FROM l, n""")
def node_timeout_sweep(s, d):
    events = event_table(s, d)
    nodes = events.groupBy("node_id").agg(F.max("timestamp").alias("last_seen")).withColumn("status", F.lit("online"))
    now = events.agg(F.max("timestamp").alias("now")).scalar()
    return registry.timeout_sweep(nodes, now, 86_400).select("node_id", "status")


@query("""WITH c AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id AS cluster_id, role AS new_master, turn AS since, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS until FROM c WHERE role IS DISTINCT FROM before""")
def leader_history(s, d):
    return elections.leader_history(read_table(s, d, "conversations").select(F.col("conv_id").alias("cluster_id"), F.col("role").alias("new_master"), F.col("turn").alias("timestamp"), F.lit(0).alias("seq")))


@query("SELECT max(s_name) AS node_id FROM supplier WHERE s_acctbal >= 0 AND s_nationkey > 3")
def elected_leader(s, d):
    return elections.leader(read_table(s, d, "supplier").select(F.col("s_name").alias("node_id"), (F.col("s_acctbal") >= 0).alias("alive"), (F.col("s_nationkey") > 3).alias("can_be_master")))


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS nth FROM events QUALIFY nth <= 5")
def user_activity_latest(s, d):
    return registry.latest_activities(event_table(s, d), 5, [F.desc("timestamp"), F.desc("event_id")]).select("user_id", "event_id", "nth")


@query("""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY ALL)
SELECT CAST(sum(n - 1) AS BIGINT) AS hits, count(*) AS misses, round(100.0 * sum(n - 1) / sum(n), 2) AS hit_rate FROM c""")
def cache_hit_rate(s, d):
    return registry.hit_rate(event_table(s, d), "user_id")


# ---- namespace


@query(f"WITH {_PATHS} SELECT path, parent_path, name, is_file, file_id, depth FROM tree")
def namespace_paths(s, d):
    return path_table(s, d)


@query(f"WITH {_PATHS}, p AS (SELECT min(parent_path) AS p FROM tree WHERE depth = 2) SELECT name, is_file, file_id FROM tree WHERE parent_path = (SELECT p FROM p)")
def namespace_list(s, d):
    tree = path_table(s, d)
    return namespace.list_directory(tree, tree.where("depth = 2").agg(F.min("parent_path")).first()[0] or "/")


@query(f"WITH {_PATHS} SELECT path, file_id FROM tree WHERE is_file AND regexp_matches(path, '^/.*[0-9].*\\.html$')")
def namespace_glob(s, d):
    return namespace.search_glob(path_table(s, d), "/*[0-9]*.html")


@query(f"WITH {_PATHS} SELECT path, depth, is_file, depth = 2 AND NOT is_file AS truncated FROM tree WHERE depth <= 2")
def namespace_tree(s, d):
    return namespace.subtree(path_table(s, d), "/", 2)


@query(f"WITH {_PATHS}, p AS (SELECT min(path) AS p FROM tree WHERE NOT is_file) SELECT path, is_file FROM tree WHERE path = (SELECT p FROM p) OR starts_with(path, (SELECT p FROM p) || '/')")
def namespace_delete_preview(s, d):
    tree = path_table(s, d)
    top = tree.where("not is_file").agg(F.min("path")).first()[0] or "/"
    return namespace.deleted_by(tree, top, recursive=True).select("path", "is_file")


@query(f"""WITH {_PATHS}, q AS (SELECT DISTINCT url FROM pages), r AS (SELECT url AS requested, '/' || array_to_string(list_filter(string_split(url, '/'), lambda x: x <> ''), '/') AS asked,
  '/' || array_to_string(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''), '/') AS real_path FROM q)
SELECT requested, CASE WHEN t.file_id IS NOT NULL THEN real_path END AS path, t.file_id FROM r LEFT JOIN tree t ON t.path = real_path AND t.is_file""")
def alias_resolution(s, d):
    urls = read_table(s, d, "pages").select("url").distinct()
    tree = path_table(s, d)
    target = S.normal_path(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1))
    aliases = urls.select(S.normal_path(F.col("url")).alias("alias"), target.alias("real_path"))
    return namespace.resolve(urls.select(F.col("url").alias("path")), tree, aliases.dropDuplicates(["alias"]))


# ---- types, ids, sizes, states


def _case(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} IN ({', '.join(repr(e) for e in endings)}) THEN '{kind}'" for kind, endings in S.EXTENSIONS.items()) + " ELSE 'other' END"


_SUFFIX = r"u AS (SELECT page_id, lower(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/.](\.[^./]*)$', 1)) AS x FROM pages)"
_MIME = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.MEDIA.items()) + " ELSE 'application/octet-stream' END"


@query(f"WITH {_SUFFIX} SELECT page_id, {_case('x')} AS type FROM u")
def file_type_by_extension(s, d):
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    return read_table(s, d, "pages").select("page_id", S.type_by_extension(path).alias("type"))


@query(f"""WITH {_SUFFIX}, m AS (SELECT page_id, {_MIME} AS mime FROM u)
SELECT page_id, mime, CASE WHEN starts_with(mime, 'image') THEN 'image' WHEN starts_with(mime, 'video') THEN 'video' WHEN starts_with(mime, 'audio') THEN 'audio' WHEN starts_with(mime, 'text') OR contains(mime, 'document') THEN 'document' ELSE 'other' END AS scanned,
CASE WHEN starts_with(mime, 'image/') THEN 'image' WHEN starts_with(mime, 'video/') THEN 'video' WHEN starts_with(mime, 'audio/') THEN 'audio' WHEN mime IN ('text/plain', 'application/pdf', 'application/msword') THEN 'document' ELSE 'other' END AS uploaded FROM m""")
def file_type_by_mime(s, d):
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    rows = read_table(s, d, "pages").select("page_id", S.media_type(path).alias("mime"))
    return rows.select("page_id", "mime", S.type_by_media_scan(F.col("mime")).alias("scanned"), S.type_by_media_upload(F.col("mime")).alias("uploaded"))


@query("""SELECT doc_id, substring(sha256(source || ':' || doc_id || ':' || sha256(coalesce(text, ''))), 1, 16) AS scan_id, source || '_' || substring(sha256(coalesce(text, '')), 1, 16) AS upload_id, source || '_' || md5(CAST(doc_id AS VARCHAR)) AS import_id FROM documents""")
def file_ids(s, d):
    rows = read_table(s, d, "documents").withColumn("h", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).withColumn("rel", F.col("doc_id").cast("string"))
    node, rel, h = F.col("source"), F.col("rel"), F.col("h")
    return rows.select("doc_id", S.scan_id(node, rel, h).alias("scan_id"), S.upload_id(node, h).alias("upload_id"), S.import_id(node, rel).alias("import_id"))


@query("""SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) ELSE printf('%.1f GB', b / 1073741824) END AS size
FROM (SELECT doc_id, CAST(n_chars * 64 AS DOUBLE) AS b FROM documents)""")
def human_size(s, d):
    return read_table(s, d, "documents").select("doc_id", S.human_size(F.col("n_chars") * 64).alias("size"))


@query("SELECT s_suppkey AS node_id, CASE WHEN s_acctbal < 0 THEN 'offline' WHEN s_nationkey < 5 THEN 'unknown' ELSE 'online' END AS status FROM supplier")
def status_normalise(s, d):
    raw = F.when(F.col("s_acctbal") < 0, "NodeStatus.OFFLINE").when(F.col("s_nationkey") < 5, "starting").otherwise("Online ")
    return read_table(s, d, "supplier").select(F.col("s_suppkey").alias("node_id"), S.normal_status(raw).alias("status"))


# ---- checkpoints and health


_ENTRY = "file_id || '|' || content_hash || '|' || strftime(last_updated, '%Y-%m-%d')"
_DIGEST = f"""{_FILES}, ranges AS (SELECT node_id, substring(md5(CAST(file_id AS VARCHAR)), 1, 3) AS part, count(*) AS n, sha256(string_agg({_ENTRY}, ',' ORDER BY {_ENTRY})) AS d FROM files GROUP BY ALL),
points AS (SELECT node_id, CAST(sum(n) AS BIGINT) AS files_count, sha256(string_agg(part || ':' || d, ',' ORDER BY part || ':' || d)) AS checkpoint_hash FROM ranges GROUP BY node_id)"""


def _points(s, d):
    entry = F.concat_ws("|", F.col("file_id").cast("string"), "content_hash", F.date_format("last_updated", "yyyy-MM-dd"))
    return checkpoints.digests(file_table(s, d), entry)


@query(f"WITH {_DIGEST} SELECT * FROM points")
def checkpoint_digest(s, d):
    return _points(s, d)


@query(f"WITH {_DIGEST} SELECT count(*) AS nodes, CAST(sum(files_count) AS BIGINT) AS total_files, sha256(string_agg(node_id || ':' || checkpoint_hash, ',' ORDER BY node_id || ':' || checkpoint_hash)) AS global_hash FROM points")
def coordinated_checkpoint(s, d):
    return checkpoints.coordinated(_points(s, d))


@query(f"""WITH {_NODES} SELECT count(*) FILTER (WHERE status = 'online') AS online, count(*) FILTER (WHERE status = 'offline') AS offline, count(*) FILTER (WHERE status = 'online') > 0 AS healthy,
(SELECT count(*) FROM orders) AS files FROM nodes""")
def cluster_health(s, d):
    return registry.cluster_health(node_table(s, d), read_table(s, d, "orders").agg(F.count(F.lit(1)).alias("files")))


# ---- the rest of the inventory


@query("""WITH p AS (SELECT l_partkey AS file_id, l_suppkey AS node_id, l_extendedprice AS score, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey, l_extendedprice DESC) AS seen FROM lineitem)
SELECT file_id, node_id, score FROM p WHERE seen = 1 ORDER BY score DESC, file_id LIMIT 20""")
def merge_partial_results(s, d):
    parts = read_table(s, d, "lineitem").select(F.col("l_suppkey").alias("node_order"), F.col("l_partkey").alias("file_id"), F.col("l_suppkey").alias("node_id"), F.col("l_extendedprice").alias("score"))
    return routing.merge_results(parts, 20)


@query("""WITH p AS (SELECT l_partkey AS file_id, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL) SELECT file_id, score FROM p ORDER BY score DESC, file_id LIMIT 20""")
def merge_best_results(s, d):
    parts = read_table(s, d, "lineitem").select(F.col("l_suppkey").alias("node_order"), F.col("l_partkey").alias("file_id"), F.col("l_suppkey").alias("node_id"), F.col("l_extendedprice").alias("score"))
    return routing.merge_results(parts, 20, "best").select("file_id", "score")


@query("""SELECT user_id AS node_id, arg_max(value, ts) FILTER (WHERE event_type = 'view') AS cpu_usage, arg_max(value, ts) FILTER (WHERE event_type = 'click') AS memory_usage FROM events GROUP BY ALL""")
def latest_node_loads(s, d):
    events = read_table(s, d, "events").select(
        F.col("user_id").alias("node_id"),
        F.col("ts").alias("timestamp"),
        F.lit(None).cast("int").alias("active_queries"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("cpu_usage"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("memory_usage"),
        F.lit(None).cast("bigint").alias("document_count"),
    )
    return routing.latest_loads(events).select("node_id", "cpu_usage", "memory_usage")


@query("SELECT count(*) AS queries, round(avg(value), 6) AS mean_latency_ms FROM events")
def query_latency(s, d):
    return routing.query_stats(read_table(s, d, "events").select(F.col("value").alias("latency_ms")))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id AS node_id, max(ts) AS seen FROM events GROUP BY ALL)
SELECT node_id, CASE WHEN (epoch_us(now) - epoch_us(seen)) / 1e6 > 21600 THEN 'offline' ELSE 'online' END AS status, CAST(floor((epoch_us(now) - epoch_us(seen)) / 1e6 / 21600) AS BIGINT) AS missed_beats FROM l, n""")
def heartbeat_states(s, d):
    events = event_table(s, d)
    now = events.agg(F.max("timestamp").alias("now")).scalar()
    return heartbeats.node_states(events, now, 21_600).select("node_id", "status", "missed_beats")


@query(f"""WITH {_NODES}, {_FILES}, own AS (SELECT DISTINCT file_id FROM files WHERE node_id = 3),
h AS (SELECT file_id, count(DISTINCT node_id) FILTER (WHERE status = 'online' AND node_id <> 3) AS holders FROM files JOIN own USING (file_id) LEFT JOIN nodes USING (node_id) GROUP BY file_id HAVING holders < 2),
r AS (SELECT h.file_id, n.node_id, 2 - holders AS missing, row_number() OVER (PARTITION BY h.file_id ORDER BY md5(h.file_id || ':' || n.node_id), n.node_id) AS k
  FROM h, nodes n WHERE n.status = 'online' AND n.node_id <> 3 AND NOT EXISTS (SELECT 1 FROM files f WHERE f.file_id = h.file_id AND f.node_id = n.node_id))
SELECT file_id, node_id FROM r WHERE k <= missing""")
def recovery_plan(s, d):
    return replication.recovery_plan(file_table(s, d), node_table(s, d), 3)


@query(f"WITH {_FILES} SELECT node_id, count(*) FILTER (WHERE node_id % 7 = 0 AND file_id % 3 = 0) = 0 AND node_id % 11 <> 0 AS valid, count(*) AS files_count FROM files GROUP BY node_id")
def checkpoint_verify(s, d):
    files = file_table(s, d)
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    points = checkpoints.checkpoint(files, now)
    # some snapshots are damaged: files with another content, nodes that lost all of theirs
    hash_ = F.when((F.col("node_id") % 7 == 0) & (F.col("file_id") % 3 == 0), "damaged").otherwise(F.col("content_hash"))
    damaged = checkpoints.snapshot(files, now).withColumn("content_hash", hash_).where("node_id % 11 <> 0")
    return checkpoints.verify(points, damaged, ["files_count"])


@query(f"WITH {_FILES} SELECT node_id, count(*) AS files, count(*) AS restored FROM files GROUP BY node_id")
def checkpoint_restore(s, d):
    files = file_table(s, d).select("node_id", "file_id", "content_hash", "last_updated")
    back = checkpoints.restore(files.where("file_id > 100"), checkpoints.snapshot(files, F.lit("2024-01-01 00:00:00").cast("timestamp")))
    return back.groupBy("node_id").agg(F.count(F.lit(1)).alias("files"), F.count_if("restored_from_checkpoint").alias("restored"))


@query(f"""WITH {_NODES}, up AS (SELECT node_id FROM nodes WHERE status = 'online' ORDER BY node_id LIMIT 3),
r AS (SELECT p_partkey AS file_id, node_id, row_number() OVER (PARTITION BY p_partkey ORDER BY node_id) AS nth FROM part, up WHERE node_id <> p_partkey % 4)
SELECT file_id, CAST(node_id AS VARCHAR) AS node_id, CAST(nth AS INTEGER) AS nth FROM r WHERE nth <= 2 AND file_id % 10 <> 0
UNION ALL SELECT p_partkey, unnest(['a', 'b']), unnest([1, 2]) FROM part WHERE p_partkey % 10 = 0""")
def replica_targets_first_nodes(s, d):
    files = part_table(s, d).select("file_id", (F.col("file_id") % 4).cast("string").alias("source"))
    first = node_table(s, d).withColumn("order", F.col("node_id")).withColumn("node_id", F.col("node_id").cast("string"))
    affine = files.where("file_id % 10 = 0").select("file_id", F.posexplode(F.array(F.lit("a"), F.lit("b"))).alias("nth", "node_id")).select("file_id", "node_id", (F.col("nth") + 1).alias("nth"))
    return replication.replica_targets(files, first, affine, order="order")


@query(f"""WITH {_NODES}, t AS (SELECT l_orderkey AS file_id, l_suppkey AS node_id FROM lineitem GROUP BY ALL)
SELECT file_id, coalesce(string_agg(t.node_id, ',' ORDER BY t.node_id) FILTER (WHERE status = 'online'), '') AS replicated_to, coalesce(string_agg(t.node_id, ',' ORDER BY t.node_id) FILTER (WHERE status = 'offline'), '') AS failed,
CASE WHEN count(*) FILTER (WHERE status = 'offline') = 0 THEN 'completed' WHEN count(*) FILTER (WHERE status = 'online') = 0 THEN 'failed' ELSE 'partial' END AS status FROM t JOIN nodes ON nodes.node_id = t.node_id GROUP BY file_id""")
def replication_log(s, d):
    targets = replica_rows(s, d).select("file_id", "node_id").distinct()
    rows = replication.replication_results(targets, node_table(s, d))
    return rows.select("file_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("replicated_to", "failed")], "status")


@query("SELECT doc_id, md5(concat_ws(' ', source, substring(text, 1, 1000), lang, concat_ws(' ', lang, source))) AS text_md5 FROM documents")
def document_texts(s, d):
    rows = read_table(s, d, "documents")
    return rows.select("doc_id", F.md5(S.document_text(F.col("source"), F.col("text"), F.col("lang"), F.array("lang", "source")).cast("binary")).alias("text_md5"))


@query("SELECT doc_id, 'http://' || source || ':8000/download/' || doc_id AS url, round(n_chars / 1048576.0, 2) AS megabytes FROM documents")
def download_urls(s, d):
    rows = read_table(s, d, "documents")
    return rows.select("doc_id", S.public_url(F.col("source"), F.lit(8000), F.col("doc_id").cast("string")).alias("url"), S.megabytes(F.col("n_chars")).alias("megabytes"))


@query("""WITH a AS (SELECT p_partkey AS file_id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS n FROM part QUALIFY n <= 20),
b AS (SELECT p_partkey AS file_id, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS n FROM part QUALIFY n <= 20)
SELECT file_id, round(sum(1.0 / (n + 60)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY file_id ORDER BY score DESC, file_id LIMIT 10""")
def hybrid_rank_fusion(s, d):
    part = read_table(s, d, "part")
    ranked = [part.select(F.col("p_partkey").alias("file_id"), F.col(c).cast("double").alias("score")).orderBy(F.desc("score"), "file_id").limit(20) for c in ("p_retailprice", "p_size")]
    return vectors.fused(*ranked, k=10)


@query("""SELECT s_suppkey AS node_id, s_name AS name, n_name AS folder FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) n ON n_nationkey = s_nationkey""")
def node_mounts(s, d):
    nodes = read_table(s, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("name"), "s_nationkey")
    mounts = nodes.join(read_table(s, d, "nation").where("n_nationkey < 10"), F.col("n_nationkey") == F.col("s_nationkey")).select("node_id", F.col("n_name").alias("folder"))
    return registry.with_mounts(nodes.drop("s_nationkey"), mounts)


@query(f"WITH {_PATHS} SELECT path, file_id FROM tree t WHERE is_file AND EXISTS (SELECT 1 FROM tree c WHERE c.parent_path = t.path)")
def files_as_folders(s, d):
    return namespace.files_as_folders(path_table(s, d)).select("path", "file_id")


@query("SELECT conv_id, turn, count(*) AS rows FROM conversations GROUP BY ALL HAVING count(*) > 1")
def key_violations(s, d):
    return registry.check_unique(read_table(s, d, "conversations"), ["conv_id", "turn"])


@query("""WITH e AS (SELECT user_id AS node_id, ts, event_type, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'completed' ELSE 'pending' END AS status FROM events),
s AS (SELECT unnest(['pending', 'in_progress', 'completed', 'failed']) AS status) SELECT s.status, count(e.status) AS tasks FROM s LEFT JOIN e USING (status) GROUP BY s.status""")
def replication_task_counts(s, d):
    is_ = lambda t: F.when(F.col("event_type") == t, F.array(F.lit("n"))).otherwise(F.array().cast("array<string>"))
    tasks = read_table(s, d, "events").select(F.col("event_id").alias("file_id"), F.array(F.lit("n")).alias("target_nodes"), is_("purchase").alias("completed_nodes"), is_("error").alias("failed_nodes"))
    return replication.task_counts(replication.task_states(tasks))


# ---- inventory: ingest, nodes, vectors, messages


@query("SELECT n_nationkey AS file_id, 200000 AS bytes, md5(left(repeat(n_name || ' ', 60000), 200000)) AS content_md5 FROM nation")
def long_contents_cut(s, d):
    long = read_table(s, d, "nation").select(F.col("n_nationkey").alias("file_id"), F.col("n_name").alias("name"), F.repeat(F.concat("n_name", F.lit(" ")), 60_000).alias("content"))
    kept = split_ingest(long)[1]
    return kept.select("file_id", F.octet_length("content").alias("bytes"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("""WITH n AS (SELECT doc_id AS file_id, text AS content FROM documents WHERE doc_id % 2 = 0), o AS (SELECT doc_id AS file_id, lang AS content FROM documents WHERE doc_id % 3 = 0),
blank AS (SELECT file_id, trim(coalesce(content, '')) = '' AS b, content FROM n)
SELECT coalesce(o.file_id, blank.file_id) AS file_id, md5(coalesce(CASE WHEN blank.file_id IS NULL OR (b AND o.file_id IS NOT NULL) THEN o.content ELSE blank.content END, '-')) AS content_md5
FROM o FULL JOIN blank ON o.file_id = blank.file_id""")
def contents_upsert(s, d):
    rows = read_table(s, d, "documents").select(F.col("doc_id").alias("file_id"), F.lit("n").alias("name"), "text", "lang")
    old = rows.where("file_id % 3 = 0").select("file_id", "name", F.col("lang").alias("content"))
    new = rows.where("file_id % 2 = 0").select("file_id", "name", F.col("text").alias("content"))
    return registry.upsert_contents(old, new).select("file_id", F.md5(F.coalesce("content", F.lit("-")).cast("binary")).alias("content_md5"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS successful, count(*) FILTER (WHERE NOT ok) AS failed
FROM (SELECT source IS NOT NULL AND n_chars <= 3000 AND text IS NOT NULL AS ok FROM documents)""")
def bulk_upload_counts(s, d):
    rows = read_table(s, d, "documents").select(F.col("source").alias("name"), F.col("n_chars").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return registry.bulk_counts(registry.bulk_outcome(rows, 3000))


@query(f"WITH {_NODES} SELECT node_id, CAST(count(l_suppkey) AS INTEGER) AS shared_files_count FROM nodes LEFT JOIN lineitem ON l_suppkey = node_id GROUP BY node_id")
def node_recount(s, d):
    return registry.recount(node_table(s, d), replica_rows(s, d)).select("node_id", "shared_files_count")


@query("""SELECT s_suppkey AS node_id, CASE WHEN s_nationkey < 10 AND s_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS folder FROM supplier WHERE s_suppkey <> 5 AND (s_nationkey < 10 OR s_nationkey >= 20)
AND (s_nationkey >= 20 OR s_nationkey % 2 = 0)""")
def mounts_put_delete(s, d):
    rows = read_table(s, d, "supplier").select(F.col("s_suppkey").alias("node_id"), "s_nationkey")
    old = rows.where("s_nationkey >= 20 or s_nationkey = 4").select("node_id", F.lit("old").alias("folder"))
    new = rows.where("s_nationkey < 10 and s_nationkey % 2 = 0").select("node_id", F.lit("new").alias("folder"))
    return registry.delete_mount(registry.put_mount(old, new), 5)


@query("""WITH o AS (SELECT s_suppkey AS node_id, CASE WHEN s_acctbal < 0 THEN 'offline' ELSE 'online' END AS status FROM supplier WHERE s_suppkey % 3 <> 0),
n AS (SELECT s_suppkey AS node_id FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(o.node_id, n.node_id) AS node_id, coalesce(o.status, 'online') AS status, CASE WHEN n.node_id IS NULL THEN 'kept' WHEN o.node_id IS NULL THEN 'registered' ELSE 'updated' END AS outcome FROM o FULL JOIN n ON o.node_id = n.node_id""")
def nodes_registered(s, d):
    nodes = node_table(s, d)
    got = registry.register_nodes(nodes.where("node_id % 3 <> 0"), nodes.where("node_id % 2 = 0"))
    return got.select("node_id", "status", F.coalesce("outcome", F.lit("kept")).alias("outcome"))


@query("""SELECT (SELECT count(*) - 1 FROM supplier) AS nodes, (SELECT count(*) FROM lineitem WHERE l_suppkey <> 3) AS files, (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey <> 3)) AS contents""")
def node_deleted(s, d):
    contents = read_table(s, d, "orders").select(F.col("o_orderkey").alias("file_id"))
    left = registry.delete_node(node_table(s, d), replica_rows(s, d), contents, 3)
    return beside(*[t.agg(F.count(F.lit(1)).alias(name)) for t, name in zip(left, ("nodes", "files", "contents"))])


@query(f"""WITH {_V}, n AS (SELECT file_id, list_transform(e, lambda x: x * 2) AS e, 99 AS node_id FROM v WHERE file_id % 4 = 0), a AS (SELECT file_id, node_id, e FROM v WHERE file_id % 4 <> 0 UNION ALL SELECT file_id, node_id, e FROM n)
SELECT file_id, node_id, round(CASE WHEN node_id = 99 THEN e[1] / (sqrt(list_inner_product(e, e)) + 1e-10) ELSE e[1] END, 6) AS first FROM a WHERE file_id % 10 <> 0""")
def vectors_registered_removed(s, d):
    rows = vector_table(s, d).withColumn("embedding", F.col("embedding").cast("array<double>"))
    new = rows.where("file_id % 4 = 0").select("file_id", F.lit(99).alias("node_id"), F.transform("embedding", lambda x: x * 2).alias("embedding"))
    left = vectors.remove(vectors.register(rows, new, 64), rows.where("file_id % 10 = 0").select("file_id"))
    return left.select("file_id", "node_id", F.round(F.element_at("embedding", 1), 6).alias("first"))


@query("SELECT vec_id AS file_id, label AS node_id FROM embeddings WHERE vec_id = 7 OR label = 2")
def vectors_located(s, d):
    rows = vector_table(s, d)
    return vectors.locate(rows, 7).union(vectors.documents_in(rows, 2)).select("file_id", "node_id").distinct()


@query("""WITH e AS (SELECT user_id AS node_id, max(ts) AS t FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT s_suppkey AS node_id, CASE WHEN e.t IS NOT NULL OR s_acctbal < 0 THEN 'offline' ELSE 'online' END AS status, epoch_us(e.t) AS last_failure_us FROM supplier LEFT JOIN e ON e.node_id = s_suppkey""")
def failures_mark_nodes(s, d):
    new = event_table(s, d).where("event_type = 'error'").select("node_id", "timestamp")
    _, nodes = reliability.record_failure(new.limit(0), node_table(s, d), new)
    return nodes.select("node_id", "status", F.unix_micros(F.col("last_failure").cast("timestamp")).alias("last_failure_us"))


@query("""WITH f AS (SELECT user_id AS node_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events WHERE event_type = 'error'), n AS (SELECT max(ts) AS now FROM events)
SELECT node_id, epoch_us(ts) AS failed_us, CASE WHEN nth = 1 AND node_id % 2 = 0 THEN (epoch_us(now) - epoch_us(ts)) / 1e6 END AS downtime_seconds FROM f, n""")
def failures_recovered(s, d):
    events = event_table(s, d).where("event_type = 'error'")
    open_ = events.select("node_id", "timestamp", F.lit(None).cast("timestamp").alias("recovery_time"), F.lit(None).cast("double").alias("downtime_seconds"))
    now = event_table(s, d).agg(F.max("timestamp").alias("now")).scalar()
    back = events.where("node_id % 2 = 0").select("node_id").distinct().withColumn("timestamp", now)
    got = reliability.record_recovery(open_, back)
    return got.select("node_id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("failed_us"), "downtime_seconds")


@query(f"""WITH {_PATHS} SELECT parent_path AS path, count(*) AS child_count, string_agg(name, ',' ORDER BY name) AS child_names FROM tree WHERE NOT starts_with(path, (SELECT min(path) FROM tree) || '/') AND path <> (SELECT min(path) FROM tree) GROUP BY ALL
UNION ALL SELECT '/own', 1, 'note.txt'""")
def namespace_children(s, d):
    tree = path_table(s, d)
    first = tree.agg(F.min("path")).first()[0] or "/none"
    left = namespace.remove_child(namespace.add_child(tree, "/own", "note.txt", True), "/".join(first.split("/")[:-1]), first.split("/")[-1])
    return namespace.children(left).select("path", "child_count", F.array_join("child_names", ",").alias("child_names"))


@query(f"""WITH {_PATHS}, old AS (SELECT '/alias' || file_id AS alias, '/gone' AS real_path FROM tree WHERE is_file AND file_id % 2 = 0), asked AS (SELECT '/alias' || file_id AS alias, path AS real_path, is_file FROM tree WHERE file_id % 3 = 0 OR NOT is_file)
SELECT alias, real_path FROM asked WHERE is_file UNION ALL SELECT alias, real_path FROM old WHERE alias NOT IN (SELECT alias FROM asked WHERE is_file)""")
def aliases_created(s, d):
    tree = path_table(s, d)
    name = F.concat(F.lit("/alias"), F.col("file_id").cast("string"))
    old = tree.where("is_file and file_id % 2 = 0").select(name.alias("alias"), F.lit("/gone").alias("real_path"))
    new = tree.where("file_id % 3 = 0 or not is_file").select(F.coalesce(name, F.lit("/folder")).alias("alias"), F.col("path").alias("real_path"))
    return namespace.create_aliases(old, new, tree)


@query("""SELECT event_id, event_type AS type, CAST(user_id AS VARCHAR) AS sender_id, round(value, 6) AS value, epoch_us(ts) AS sent_us FROM (SELECT *, CASE WHEN event_type = 'click' THEN 'PING' WHEN event_type = 'view' THEN 'PONG' END AS t FROM events) WHERE t IS NOT NULL""")
def message_frames(s, d):
    rows = read_table(s, d, "events").withColumn("kind", F.when(F.col("event_type") == "click", "PING").when(F.col("event_type") == "view", "PONG").otherwise("NONE"))
    sent = S.frame(F.col("kind"), F.col("user_id").cast("string"), F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("value"), F.col("value").cast("string")), F.col("ts").cast("timestamp"))
    # to milliseconds only goes the JSON form of a time, so the payload carries the exact one
    got = rows.select("event_id", S.unframe(sent).alias("m"), F.unix_micros(F.col("ts").cast("timestamp")).alias("sent_us")).where("m is not null")
    return got.select("event_id", F.element_at("m.payload", F.lit("event_type")).alias("type"), "m.sender_id", F.round(F.element_at("m.payload", F.lit("value")).cast("double"), 6).alias("value"), "sent_us")


@query("""WITH m AS (SELECT user_id AS node_id, ts, event_type, event_id % 10 = 0 AS broken FROM events WHERE event_type IN ('click', 'view'))
SELECT CASE WHEN NOT broken THEN CAST(node_id AS VARCHAR) END AS node_id, count(*) AS messages, max(CASE WHEN NOT broken THEN epoch_us(ts) END) AS last_us FROM m GROUP BY 1""")
def message_stream(s, d):
    # frames as another job writes them, a tenth of them cut; taken up by a stream in several batches
    events = read_table(s, d, "events").withColumn("kind", F.when(F.col("event_type") == "click", "PING").when(F.col("event_type") == "view", "PONG"))
    sent = S.frame(F.col("kind"), F.col("user_id").cast("string"), F.create_map().cast("map<string,string>"), F.col("ts").cast("timestamp"))
    sent = events.where("kind is not null").select(F.when(F.col("event_id") % 10 == 0, F.substring(sent, 1, 20)).otherwise(sent).alias("value"))
    folder = f"{shared_folder(s)}/frames-{uuid.uuid4().hex}"
    sent.repartition(3).write.parquet(f"{folder}/in")
    rows = messages.messages(messages.read_frames(s, f"{folder}/in", 2))
    query = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = s.read.parquet(f"{folder}/out")
    return got.groupBy(F.col("sender_id").alias("node_id")).agg(F.count(F.lit(1)).alias("messages"), F.max(F.unix_micros("timestamp")).alias("last_us"))


@query("""WITH m AS (SELECT user_id AS node_id, ts FROM events WHERE event_type IN ('click', 'view') AND user_id % 3 <> 0), n AS (SELECT max(ts) AS now FROM events)
SELECT node_id, epoch_us(max(ts)) AS last_us, CASE WHEN epoch_us(any_value(now)) - epoch_us(max(ts)) > 86400000000 THEN 'offline' ELSE 'online' END AS status FROM m, n GROUP BY node_id""")
def heartbeats_of_known_peers(s, d):
    events = event_table(s, d)
    kind = F.when(F.col("event_type") == "click", "PING").when(F.col("event_type") == "view", "PONG").otherwise("ELECTION")
    messages = events.select(kind.alias("type"), F.col("node_id").alias("sender_id"), "timestamp")
    peers = events.select("node_id").where("node_id % 3 <> 0")
    states = heartbeats.node_states(heartbeats.of_peers(messages, peers), events.agg(F.max("timestamp").alias("now")).scalar(), 86_400)
    return states.select("node_id", F.unix_micros(F.col("last_seen").cast("timestamp")).alias("last_us"), "status")


@query("SELECT 'PONG' AS type, 'me' AS sender_id, user_id AS in_reply_to, count(*) AS pongs FROM events WHERE event_type = 'click' GROUP BY ALL")
def heartbeat_replies(s, d):
    messages = event_table(s, d).select(F.when(F.col("event_type") == "click", "PING").otherwise("PONG").alias("type"), F.col("node_id").alias("sender_id"), "timestamp")
    return heartbeats.replies(messages, "me").groupBy("type", "sender_id", "in_reply_to").agg(F.count(F.lit(1)).alias("pongs"))


@query("""WITH e AS (SELECT user_id AS node_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events),
o AS (SELECT node_id, epoch_us(ts) + 21600000000 AS down_us FROM e WHERE epoch_us(nxt) - epoch_us(ts) > 21600000000),
c AS (SELECT user_id AS m, ts, event_id, lag(user_id) OVER (ORDER BY ts, event_id) AS before FROM events WHERE event_type = 'purchase'),
t AS (SELECT m, epoch_us(ts) AS since, epoch_us(lead(ts) OVER (ORDER BY ts, event_id)) AS until FROM c WHERE m IS DISTINCT FROM before)
SELECT DISTINCT node_id, 'master_down' AS event, down_us AS at_us FROM o JOIN t ON m = node_id AND down_us >= since AND (until IS NULL OR down_us < until)""")
def master_down_events(s, d):
    events = event_table(s, d).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    terms = elections.leader_history(events.where("event_type = 'purchase'").select(F.col("node_id").alias("new_master"), "timestamp", F.col("event_id").alias("seq")))
    down = heartbeats.outages(events, 21_600).select("node_id", F.lit("node_down").alias("event"), (F.col("last_seen") + F.make_dt_interval(secs=F.lit(21_600))).alias("at"))
    return heartbeats.master_down(down, terms).select("node_id", "event", F.unix_micros("at").alias("at_us"))


@query("""WITH ev AS (SELECT event_id, user_id % 3 AS node_id, ts, event_type FROM events),
e AS (SELECT node_id, ts, lead(ts) OVER (PARTITION BY node_id ORDER BY ts) AS nxt FROM ev),
o AS (SELECT node_id, epoch_us(ts) + 600000000 AS down_us FROM e WHERE epoch_us(nxt) - epoch_us(ts) > 600000000),
c AS (SELECT node_id AS m, ts, event_id, lag(node_id) OVER (ORDER BY ts, event_id) AS before FROM ev WHERE event_type = 'purchase'),
t AS (SELECT m, epoch_us(ts) AS since, epoch_us(lead(ts) OVER (ORDER BY ts, event_id)) AS until FROM c WHERE m IS DISTINCT FROM before)
SELECT DISTINCT node_id, 'master_down' AS event, down_us AS at_us FROM o JOIN t ON m = node_id AND down_us >= since AND (until IS NULL OR down_us < until)""")
def leaders_that_went_down(s, d):
    events = event_table(s, d).withColumns({"timestamp": F.col("timestamp").cast("timestamp"), "node_id": F.col("node_id") % 3})
    terms = elections.leader_history(events.where("event_type = 'purchase'").select(F.col("node_id").alias("new_master"), "timestamp", F.col("event_id").alias("seq")))
    down = heartbeats.outages(events, 600).select("node_id", F.lit("node_down").alias("event"), (F.col("last_seen") + F.make_dt_interval(secs=F.lit(600))).alias("at"))
    return heartbeats.master_down(down, terms).select("node_id", "event", F.unix_micros("at").alias("at_us"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, epoch_us(ts) AS back_us FROM events""")
def iso_times(s, d):
    rows = read_table(s, d, "events").select("event_id", S.iso(F.col("ts")).alias("iso"))
    return rows.withColumn("back_us", F.unix_micros(S.from_iso(F.col("iso"))))


@query("""SELECT s_suppkey AS node_id, s_name AS name FROM supplier WHERE s_nationkey > 0 AND s_suppkey <> 4""")
def announcements_parsed(s, d):
    rows = read_table(s, d, "supplier").select(S.announce(F.col("s_suppkey").cast("string"), F.col("s_name"), F.col("s_nationkey"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("value"))
    return discovery.parse_announcements(rows, "4").select(F.col("node_id").cast("bigint").alias("node_id"), F.col("ip_address").alias("name"))


@query("SELECT event_id AS file_id, 'failed' AS status FROM events WHERE event_id = 5 AND event_type = 'error' UNION ALL SELECT event_id, 'pending' FROM events WHERE event_id = 5 AND event_type <> 'error'")
def replication_task_status(s, d):
    fails = F.when(F.col("event_type") == "error", F.array(F.lit("n"))).otherwise(F.array().cast("array<string>"))
    tasks = read_table(s, d, "events").select(F.col("event_id").alias("file_id"), F.array(F.lit("n")).alias("target_nodes"), F.array().cast("array<string>").alias("completed_nodes"), fails.alias("failed_nodes"))
    return replication.task_status(tasks, 5).select("file_id", "status")
