"""Queries of scalar operators, lists and files, graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinmap.functions import scalars
from kinmap.operators import catalogs, graphs, match
from kinmap.plans import images, matching, search
from kinmap.plans.fixtures import SQL_D, SQL_E, descriptors, table, vectors

_EXT = ("jpg", "PNG", "nef", "tif", "txt", "jpeg", "dng")
_SQL_EXT = "[" + ", ".join(f"'{e}'" for e in _EXT) + "]"


def paths(spark, sf):
    """page_id, path: files of every kind, some of the same base name in two folders, some in folders of thumbnails."""
    ext = F.element_at(F.array(*map(F.lit, _EXT)), F.expr("cast(page_id % 7 + 1 AS int)"))
    folder = F.when(F.expr("page_id % 10 = 3"), "world/mythumb").when(F.expr("page_id % 2 = 0"), "world/a").otherwise("world/b")
    return table(spark, sf, "pages").select("page_id", F.concat(folder, F.lit("/img."), F.expr("page_id div 2"), F.lit("."), ext).alias("path"))


SQL_PATHS = f"""paths AS (SELECT page_id, CASE WHEN page_id % 10 = 3 THEN 'world/mythumb' WHEN page_id % 2 = 0 THEN 'world/a' ELSE 'world/b' END
  || '/img.' || (page_id // 2) || '.' || {_SQL_EXT}[page_id % 7 + 1] AS path FROM pages)"""


def sizes(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.expr("200 + (vec_id * 131) % 3000").alias("w"), F.expr("150 + (vec_id * 97) % 2500").alias("h"))


SQL_SIZES = "sizes AS (SELECT vec_id, 200 + vec_id * 131 % 3000 AS w, 150 + vec_id * 97 % 2500 AS h FROM embeddings)"


def image_type_predicate(spark, sf):
    return paths(spark, sf).select("page_id", scalars.is_image("path").alias("is_image"), scalars.is_raw("path").alias("is_raw"))


def path_parts(spark, sf):
    return paths(spark, sf).select("page_id", scalars.basename("path").alias("name"), scalars.extension("path").alias("ext"), scalars.stem("path").alias("stem"), F.substring("path", 1, 7).alias("head"))


def mime_guess(spark, sf):
    return paths(spark, sf).select("page_id", scalars.media_type("path").alias("mime"))


def directory_first_wins(spark, sf):
    return catalogs.listed_files(paths(spark, sf))


def rotation90_test(spark, sf):
    own = sizes(spark, sf)
    return own.select("vec_id", scalars.rotated_90("w", "h", F.expr("150 + (vec_id * 89) % 2500"), F.expr("200 + (vec_id * 127) % 3000")).alias("rotated"))


def resize_plan(spark, sf):
    fw, fh = scalars.fit_pixels("w", "h", 500_000)
    cw, ch = scalars.cap_width("w", "h")
    pw, ph = scalars.cap_pixels("w", "h")
    return sizes(spark, sf).select("vec_id", fw.alias("fit_w"), fh.alias("fit_h"), cw.alias("cap_w"), ch.alias("cap_h"), pw.alias("hd_w"), ph.alias("hd_h"))


def rootsift(spark, sf):
    own = vectors(spark, sf).select("vec_id", F.transform("e", F.abs).alias("e"))
    return own.select("vec_id", F.posexplode(scalars.root_sift("e")).alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 9).alias("v"))


def bit_unpack(spark, sf):
    own = vectors(spark, sf).select("vec_id", F.expr("transform(e, x -> cast(floor((x + 1) * 127.5D) AS int))").alias("bytes"))
    return own.select("vec_id", F.posexplode(scalars.unpack_bits("bytes")).alias("i", "bit")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("bit").cast("long").alias("bit"))


_MATRIX = [[((i * 7 + r * 3) % 11 - 5) / 10 for i in range(64)] for r in range(4)]


def linear_transform(spark, sf):
    out = vectors(spark, sf).select("vec_id", F.posexplode(scalars.linear_transform("e", _MATRIX, [0.5, 0.0, -0.5, 1.0])).alias("r", "v"))
    return out.select("vec_id", F.col("r").cast("long").alias("r"), F.round("v", 9).alias("v"))


def sanitize_vectors(spark, sf):
    return vectors(spark, sf).select("vec_id", F.posexplode(scalars.sanitize("e")).alias("i", "v")).groupBy("vec_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v").cast("double")), 6).alias("total"))


def feature_validity(spark, sf):
    """Vectors of odd ids are cut short; only whole ones are kept, and only they get an id."""
    own = vectors(spark, sf).select("vec_id", F.expr("if(vec_id % 3 = 1, slice(e, 1, 32), e)").alias("vec"))
    kept = own.filter(scalars.is_descriptor("vec"))
    return catalogs.dense_ids(kept.select("vec_id"), "vec_id", [], "image_id")


def keypoint_cap(spark, sf):
    return descriptors(spark, sf).filter("kp_idx < 10").select("image_id", "kp_idx")


def keypoint_rescale(spark, sf):
    own = descriptors(spark, sf).select("image_id", "kp_idx", F.expr("cast((vec_id * 37) % 640 AS double)").alias("x"), F.expr("1.0D / (1 + version)").alias("scale"))
    return own.select("image_id", "kp_idx", scalars.rescaled("x", "scale").alias("x"))


def index_key_parse(spark, sf):
    keys = table(spark, sf, "embeddings").select("vec_id", F.expr("concat(element_at(array('OPQ32_96,', 'OPQ16,', 'PCAR64,', ''), cast(vec_id % 4 + 1 AS int)), 'IVF', 16 + vec_id, ',', if(vec_id % 3 = 0, 'Flat', concat('PQ', 8 + vec_id % 5)))").alias("key"))
    parts = scalars.index_key("key")
    return keys.select("vec_id", *(c.alias(n) for n, c in parts.items()))


def ram_capacity(spark, sf):
    own = table(spark, sf, "embeddings").select("vec_id", F.expr("1.0D + vec_id / 4").alias("gb"))
    return own.select("vec_id", scalars.vectors_in_memory("gb", 64, False).alias("full"), scalars.vectors_in_memory("gb", 96, True).alias("half"))


def job_partition(spark, sf):
    own = table(spark, sf, "embeddings").select("vec_id")
    n = own.count()
    return own.select("vec_id", scalars.job_of("vec_id", F.lit(n), 7).alias("job"))


def feature_offsets(spark, sf):
    files = descriptors(spark, sf).groupBy("image_id").agg((F.count("*") * 256 + 80).alias("size")).select(F.expr("concat('img', lpad(image_id, 6, '0'))").alias("name"), "size")
    return catalogs.feature_offsets(files, "name", "size", 64)


def dense_image_ids(spark, sf):
    return catalogs.image_ids(paths(spark, sf), "path")


def topk_by_response(spark, sf):
    own = descriptors(spark, sf).select("image_id", "kp_idx", F.round(F.element_at("vec", 1), 9).alias("response"))
    return catalogs.strongest(own, ["image_id"], 5)


def training_sample(spark, sf):
    """Every row of the sampled files."""
    chosen = catalogs.sampled_files(descriptors(spark, sf).select("image_id").distinct(), "image_id", 200, 20)
    return descriptors(spark, sf).join(chosen, "image_id", "left_semi").select("image_id", "kp_idx", "vec_id")


def world_index_scan(spark, sf):
    """Lines of a pipe-separated index, parsed with its header's schema and joined to a folder."""
    lines = sizes(spark, sf).select(F.concat_ws("|", F.lit("provenance"), F.md5(F.col("vec_id").cast("string")), F.concat(F.lit("world/"), F.md5(F.col("vec_id").cast("string")), F.lit(".jpg")), "w", "h").alias("line"))
    parsed = lines.select(F.from_csv("line", "TaskID STRING, WorldFileID STRING, WorldFileName STRING, WorldWidth INT, WorldHeight INT", {"sep": "|"}).alias("r")).select("r.*")
    return parsed.withColumn("path", F.concat_ws("/", F.lit("/data"), "WorldFileName"))


def _ranked(spark, sf):
    top = search.vote_tally_weighted(spark, sf).filter("pos <= 6")
    return top.select("q_image", "pos", F.expr("concat(image_id, '.v', image_id % 4, '.jpg')").alias("name"), F.col("votes").alias("score"), "image_id")


def nodes_explode(spark, sf):
    """Filtering results written as JSON and read again."""
    return catalogs.result_nodes(catalogs.result_json(_ranked(spark, sf), "q_image"), "q_image")


def fold_builder(spark, sf):
    return catalogs.folds(_ranked(spark, sf), "q_image", 3).select("fold_id", "q_image", "pos", "name")


def rank_file(spark, sf):
    """name,score lines, the first n of each probe."""
    lines = _ranked(spark, sf).filter("pos <= 4").select("q_image", F.concat_ws(",", "name", "score").alias("line"))
    parsed = lines.select("q_image", F.split("line", ",").alias("p"))
    return parsed.select("q_image", F.concat(F.lit("world/"), F.col("p")[0]).alias("file"), F.col("p")[1].cast("double").alias("score"))


def manifest_lines(spark, sf):
    own = search.probes(spark, sf).select(F.col("q_image").cast("string").alias("probe_id")).distinct()
    return catalogs.manifest(own, own.filter("cast(probe_id AS int) % 3 <> 0"), "probe_id")


def manifest_antijoin(spark, sf):
    own = paths(spark, sf).select("path")
    status = F.expr("element_at(array('completed', 'unable', 'uncompleted', 'completed', 'none'), cast(page_id % 5 + 1 AS int))")
    ledgers = paths(spark, sf).select("path", status.alias("status")).filter("status <> 'none'")
    return catalogs.pending(own, ledgers.unionByName(ledgers.filter("status = 'completed'")), "path")


def probe_prefix_lookup(spark, sf):
    ids = table(spark, sf, "pages").select(F.expr("concat('p', page_id div 2)").alias("id")).distinct()
    files = table(spark, sf, "pages").select(F.expr("concat('world/p', page_id div 2, '.', page_id % 2, '.jpg')").alias("path"))
    return catalogs.find_by_prefix(ids, files)


def _trees(spark, sf):
    """Nested documents that refer to resources at several depths, one of them twice."""
    tree = """concat('{"image":{"$resource":"r', page_id, '"},"parts":[{"mask":{"$indirect":"file:///m/', page_id, '"}},{"mask":{"$resource":"r', page_id, '"}}],"note":{"text":"$resource"},"n":', page_id, '}')"""
    return table(spark, sf, "pages").select("page_id", F.expr(tree).alias("json"))


def resource_references(spark, sf):
    return catalogs.references(_trees(spark, sf), "page_id", "json")


def resource_replace(spark, sf):
    """References with a known resource become its content; of every third page the resource is not known, and the reference stays."""
    known = table(spark, sf, "pages").filter("page_id % 3 <> 0").select(F.expr("concat('r', page_id)").alias("ref"), F.expr("concat('content of ', page_id)").alias("content"))
    return catalogs.replace_references(_trees(spark, sf), "page_id", "json", known)


def query_matrix_ids(spark, sf):
    """Rows of all query files in order, each with its file's number."""
    own = descriptors(spark, sf).filter("version = 1").select(F.expr("concat('q', lpad(image_id, 6, '0'), '.npy')").alias("file"), "kp_idx")
    ids = catalogs.image_ids(own, "file").withColumnRenamed("image_id", "qid")
    return catalogs.dense_ids(own.join(ids, own["file"] == ids["name"]).select("qid", "kp_idx"), "qid", ["kp_idx"], "row")


def _tree(spark, sf):
    """A directed edge from each version to the next, weighted by matches."""
    return images.links(spark, sf).filter("i < j AND j = i + 1").select("family", F.col("i").alias("src"), F.col("j").alias("dst"), (F.col("kp") / 20).alias("weight"))


def graph_associations(spark, sf):
    nodes = descriptors(spark, sf).filter("version <> 2").select("family", F.col("image_id").alias("node")).distinct().withColumn("name", F.expr("concat(node, '.jpg')"))
    return graphs.associations(nodes, _tree(spark, sf), "family")


def graph_node_renumber(spark, sf):
    return graphs.renumbered(_tree(spark, sf), "family")


def graph_first_seen(spark, sf):
    order = Window.partitionBy("family").orderBy(F.col("dst").desc())
    named = _tree(spark, sf).select("family", F.concat(F.lit("n"), "src").alias("source"), F.concat(F.lit("n"), "dst").alias("target"), (F.row_number().over(order) - 1).alias("pos"))
    return graphs.first_seen(named, "family")


def journal_chain(spark, sf):
    """Links from each image to later versions; the chain takes the smallest."""
    links = images.links(spark, sf).filter("i < j").select(F.col("i").alias("source"), F.col("j").alias("target"))
    return graphs.follow_chain(links, links.filter("source % 4 = 0").select(F.col("source").alias("start")).distinct())


def originals_and_modified(spark, sf):
    """Links whose two ends are both indexed and differ."""
    links = images.links(spark, sf).select("i", "j")
    world = descriptors(spark, sf).filter("version <> 3").select(F.col("image_id").alias("node")).distinct()
    return links.join(world.withColumnRenamed("node", "i"), "i", "left_semi").join(world.withColumnRenamed("node", "j"), "j", "left_semi").filter("i <> j").select("i", "j")


def _probe_cells(spark, sf):
    own = images.cells(spark, sf)
    number = lambda c: F.col(c) - 4 * F.col("family")  # noqa: E731  node 0 is the original
    return own.select(F.col("family").alias("probe_id"), number("i").alias("i"), number("j").alias("j"), "kp", "dist", F.col("mi_out").alias("mi"))


def cluster_graph(spark, sf):
    return graphs.cluster_graph(_probe_cells(spark, sf), "probe_id")


def kruskal_tree(spark, sf):
    """Of the joined matrices of matches and mutual information, in which what is absent is poisoned."""
    own = images.joined_cells(spark, sf).select(F.col("family").alias("probe_id"), (F.col("i") - 4 * F.col("family")).alias("i"), (F.col("j") - 4 * F.col("family")).alias("j"), "value")
    return graphs.kruskal_tree(own, "probe_id", "value", absent=-0.5)


def graph_query(spark, sf):
    """The whole graph query: for each probe the images reached from it, the measures of their candidate pairs as matrices, the graph grown
    from the probe, and its edges as associations between files."""
    starts = matching.bfs_levels(spark, sf)
    pairs = match.candidate_pairs(starts)
    both = pairs.unionByName(pairs.select("start", F.col("j").alias("i"), F.col("i").alias("j")))
    node = lambda c: F.when(F.col(c) == F.col("start"), 0).otherwise(F.col(c) + 1)  # noqa: E731  node 0 is the probe
    measured = both.join(images.cells(spark, sf), ["i", "j"]).select(F.col("start").alias("probe_id"), node("i").alias("i"), node("j").alias("j"), "kp", "dist", F.col("mi_out").alias("mi"))
    edges = graphs.cluster_graph(measured, "probe_id").withColumn("weight", F.lit(1.0))
    named = starts.select(F.col("start").alias("probe_id"), node("node").alias("node"), F.concat(F.lit("world/"), "node", F.lit(".jpg")).alias("name"))
    return graphs.associations(named, edges, "probe_id")


def graph_json_text(spark, sf):
    edges = kruskal_tree(spark, sf)
    nodes = graphs.renumbered(edges, "probe_id")
    a, b = nodes.select("probe_id", F.col("node").alias("src"), F.col("number").alias("source")), nodes.select("probe_id", F.col("node").alias("dst"), F.col("number").alias("target"))
    links = edges.join(a, ["probe_id", "src"]).join(b, ["probe_id", "dst"]).select("probe_id", "source", "target", F.col("weight").alias("confidence"))
    named = nodes.select("probe_id", "number", F.concat(F.lit("world/"), "node", F.lit(".jpg")).alias("file"), F.col("node").cast("string").alias("fileid"), F.lit(1.0).alias("confidence"))
    return graphs.graph_json(named, links.withColumn("confidence", scalars.rounded("confidence", 3)), "probe_id")


_ALL = (
    image_type_predicate, path_parts, mime_guess, directory_first_wins, rotation90_test, resize_plan, rootsift, bit_unpack, linear_transform, sanitize_vectors, feature_validity,
    keypoint_cap, keypoint_rescale, index_key_parse, ram_capacity, job_partition, feature_offsets, dense_image_ids, topk_by_response, training_sample, world_index_scan, nodes_explode,
    fold_builder, rank_file, manifest_lines, manifest_antijoin, probe_prefix_lookup, resource_references, query_matrix_ids, graph_associations, graph_node_renumber, graph_first_seen,
    journal_chain, originals_and_modified, cluster_graph, kruskal_tree, graph_json_text, resource_replace, graph_query,
)
QUERIES = {f.__name__: f for f in _ALL}

_LIST = lambda names: ", ".join(f"'{n}'" for n in names)
_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_OWN = f"regexp_extract({_NAME}, '\\.([^.]+)$', 1)"
_RANKED = f"{search.SQL_TALLY}, ranked AS (SELECT q_image, pos, image_id || '.v' || (image_id % 4) || '.jpg' AS name, votes AS score, image_id FROM pos WHERE pos <= 6)"
_TREE = f"{images.SQL_LINKS}, tree AS (SELECT family, i AS src, j AS dst, kp / 20 AS weight FROM links WHERE i < j AND j = i + 1)"
#: Kruskal's rounds: cells of the dense matrix from the heaviest on, and a label for each node; a cell joins two labels or is passed over.
_KRUSKAL = f"""{images.SQL_JOINED}, pos AS (SELECT DISTINCT family, node FROM (SELECT family, i AS node FROM jn WHERE value > 0 UNION ALL SELECT family, j FROM jn WHERE value > 0)
), cl AS (
  SELECT a.family, a.node - 4 * a.family AS i, b.node - 4 * b.family AS j, coalesce(value, -0.5) AS w, row_number() OVER (PARTITION BY a.family ORDER BY coalesce(value, -0.5) DESC, a.node, b.node) AS k
  FROM pos a JOIN pos b ON a.family = b.family LEFT JOIN jn ON jn.i = a.node AND jn.j = b.node
), kr AS (
  WITH RECURSIVE r(family, k, labels, picked) AS (
    SELECT DISTINCT family, 0::BIGINT, [0, 1, 2, 3]::BIGINT[], []::BIGINT[] FROM cl
    UNION ALL
    SELECT r.family, cl.k, if(labels[i + 1] = labels[j + 1], labels, list_transform(labels, lambda x: if(x = labels[j + 1], labels[i + 1], x))), if(labels[i + 1] = labels[j + 1], picked, list_append(picked, cl.k))
    FROM r JOIN cl ON cl.family = r.family AND cl.k = r.k + 1
  ) SELECT family, unnest(arg_max(picked, k)) AS k FROM r GROUP BY family
), tr AS (SELECT family AS probe_id, i AS src, j AS dst, w AS weight FROM kr JOIN cl USING (family, k))"""
ORACLES = {
    "image_type_predicate": f"WITH {SQL_PATHS} SELECT page_id, lower({_OWN}) IN ({_LIST(scalars.IMAGE_EXTENSIONS)}) AS is_image, {_OWN} IN ({_LIST(scalars.RAW_EXTENSIONS)}) AS is_raw FROM paths",
    "path_parts": f"WITH {SQL_PATHS} SELECT page_id, {_NAME} AS name, lower({_OWN}) AS ext, regexp_replace({_NAME}, '(.)\\.[^.]*$', '\\1') AS stem, path[1:7] AS head FROM paths",
    "mime_guess": f"WITH {SQL_PATHS} SELECT page_id, CASE lower({_OWN}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scalars.MEDIA_TYPES.items()) + f" ELSE '{scalars.NO_MEDIA_TYPE}' END AS mime FROM paths",
    "directory_first_wins": f"WITH {SQL_PATHS} SELECT {_NAME} AS name, min(path) AS path FROM paths WHERE NOT regexp_matches(path, '(^|/)[^/]*thumb/') GROUP BY ALL",
    "rotation90_test": f"""WITH {SQL_SIZES}, r AS (SELECT vec_id, w, h, 150 + vec_id * 89 % 2500 AS rw, 200 + vec_id * 127 % 3000 AS rh FROM sizes)
    SELECT vec_id, (abs(h / w - rh / rw) > abs(h / w - 1 / (rh / rw)) AND degrees(acos(least(abs((h * rw + w * rh) / (sqrt(h * h + w * w) * sqrt(rh * rh + rw * rw))), 1))) <= 25)::BIGINT AS rotated FROM r""",
    "resize_plan": f"""WITH {SQL_SIZES}, p AS (SELECT *, sqrt(h * 500000::DOUBLE / w) AS nh, h / w AS ratio FROM sizes)
    SELECT vec_id, round_even(nh * w / h, 0)::BIGINT AS fit_w, round_even(nh, 0)::BIGINT AS fit_h, if(512 / w < 1, trunc(w * (512::DOUBLE / w)), w)::BIGINT AS cap_w, if(512 / w < 1, trunc(h * (512::DOUBLE / w)), h)::BIGINT AS cap_h,
      if(w * h > 2073600, round_even(sqrt(2073600 / ratio), 0), w)::BIGINT AS hd_w, if(w * h > 2073600, round_even(ratio * round_even(sqrt(2073600 / ratio), 0), 0), h)::BIGINT AS hd_h FROM p""",
    "rootsift": f"WITH {SQL_E}, a AS (SELECT vec_id, list_transform(e, lambda x: abs(x)) AS e FROM e) SELECT vec_id, i::BIGINT AS i, round(sqrt(e[i + 1] / (list_sum(e) + 1e-8::DOUBLE)), 9) AS v FROM a, (SELECT unnest(range(64)) AS i)",
    "bit_unpack": f"WITH {SQL_E} SELECT vec_id, 8 * b + k AS i, (floor((e[b + 1] + 1) * 127.5::DOUBLE)::INT >> (7 - k)::INT & 1)::BIGINT AS bit FROM e, (SELECT unnest(range(64)) AS b), (SELECT unnest(range(8)) AS k)",
    "linear_transform": f"""WITH {SQL_E} SELECT vec_id, r, round(list_sum(list_transform(range(64), lambda i: e[i + 1] * (((i * 7 + r * 3) % 11 - 5) / 10))) + [0.5, 0.0, -0.5, 1.0][r + 1]::DOUBLE, 9) AS v
    FROM e, (SELECT unnest(range(4)) AS r)""",
    "sanitize_vectors": f"WITH {SQL_E} SELECT vec_id, len(e) AS n, round(list_sum(list_transform(e, lambda x: x::FLOAT::DOUBLE)), 6) AS total FROM e",
    "feature_validity": f"WITH {SQL_E} SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS image_id FROM e WHERE vec_id % 3 <> 1",
    "keypoint_cap": f"WITH {SQL_D} SELECT image_id, kp_idx FROM d WHERE kp_idx < 10",
    "keypoint_rescale": f"WITH {SQL_D} SELECT image_id, kp_idx, round((vec_id * 37 % 640) * (1.0::DOUBLE / (1 + version)), 6) AS x FROM d",
    "index_key_parse": """SELECT vec_id, ['OPQ32_96', 'OPQ16', 'PCAR64', ''][vec_id % 4 + 1] AS transform, 16 + vec_id AS lists, if(vec_id % 3 = 0, 'Flat', 'PQ' || (8 + vec_id % 5)) AS encoding FROM embeddings""",
    "ram_capacity": 'SELECT vec_id, floor((1.0::DOUBLE + vec_id / 4) * 1073741824 / 256)::BIGINT AS "full", floor((1.0::DOUBLE + vec_id / 4) * 1073741824 / 192)::BIGINT AS half FROM embeddings',
    "job_partition": "SELECT vec_id, ntile(7) OVER (ORDER BY vec_id) - 1 AS job FROM embeddings",
    "feature_offsets": f"WITH {SQL_D}, f AS (SELECT 'img' || lpad(image_id::VARCHAR, 6, '0') AS name, count(*) AS n FROM d GROUP BY image_id) SELECT name, n, (sum(n) OVER (ORDER BY name) - n)::BIGINT AS before, (sum(n) OVER (ORDER BY name))::BIGINT AS upto FROM f",
    "dense_image_ids": f"WITH {SQL_PATHS} SELECT path AS name, row_number() OVER (ORDER BY path) - 1 AS image_id FROM (SELECT DISTINCT path FROM paths)",
    "topk_by_response": f"WITH {SQL_D} SELECT image_id, kp_idx, response FROM (SELECT image_id, kp_idx, round(vec[1], 9) AS response, row_number() OVER (PARTITION BY image_id ORDER BY round(vec[1], 9) DESC, kp_idx) AS r FROM d) WHERE r <= 5",
    "training_sample": f"WITH {SQL_D}, f AS (SELECT image_id FROM (SELECT DISTINCT image_id FROM d) ORDER BY md5('42:' || image_id), image_id LIMIT 10) SELECT image_id, kp_idx, vec_id FROM d WHERE image_id IN (FROM f)",
    "world_index_scan": f"""WITH {SQL_SIZES} SELECT 'provenance' AS "TaskID", md5(vec_id::VARCHAR) AS "WorldFileID", 'world/' || md5(vec_id::VARCHAR) || '.jpg' AS "WorldFileName", w::INT AS "WorldWidth", h::INT AS "WorldHeight", '/data/world/' || md5(vec_id::VARCHAR) || '.jpg' AS path FROM sizes""",
    "nodes_explode": f"{_RANKED} SELECT q_image, pos, 'world/' || name AS file, image_id || '.v' || (image_id % 4) AS fileid, score FROM ranked",
    "fold_builder": f"{_RANKED} SELECT q_image::VARCHAR AS fold_id, q_image, pos, name FROM ranked WHERE pos BETWEEN 2 AND 4",
    "rank_file": f"{_RANKED} SELECT q_image, 'world/' || name AS file, score FROM ranked WHERE pos <= 4",
    "manifest_lines": f"""WITH {SQL_D}, p AS (SELECT DISTINCT q_image AS q FROM probes) SELECT q::VARCHAR AS "ProvenanceProbeFileID", 1.0::DOUBLE AS "ConfidenceScore",
      if(q % 3 <> 0, 'json/' || q || '.json', '') AS "ProvenanceOutputFileName", if(q % 3 <> 0, 'Processed', 'NonProcessed') AS "ProvenanceProbeStatus" FROM p""",
    "manifest_antijoin": f"WITH {SQL_PATHS} SELECT path FROM paths WHERE path NOT IN (SELECT path FROM paths WHERE page_id % 5 IN (0, 1, 3))",
    "probe_prefix_lookup": """WITH i AS (SELECT DISTINCT 'p' || (page_id // 2) AS id FROM pages), f AS (SELECT 'p' || (page_id // 2) || '.' || (page_id % 2) || '.jpg' AS name FROM pages)
    SELECT id, min('world/' || name) AS path FROM i JOIN f ON starts_with(name, id) GROUP BY id""",
    "resource_references": """SELECT page_id, unnest(['image', 'parts.0.mask', 'parts.1.mask']) AS key, unnest(['r' || page_id, 'file:///m/' || page_id, 'r' || page_id]) AS ref, unnest(['resource', 'indirect', 'resource']) AS kind FROM pages""",
    "resource_replace": """SELECT page_id, if(page_id % 3 <> 0,
      '{"image":"content of ' || page_id || '","n":' || page_id || ',"note":{"text":"$resource"},"parts":[{"mask":{"$indirect":"file:///m/' || page_id || '"}},{"mask":"content of ' || page_id || '"}]}',
      '{"image":{"$resource":"r' || page_id || '"},"n":' || page_id || ',"note":{"text":"$resource"},"parts":[{"mask":{"$indirect":"file:///m/' || page_id || '"}},{"mask":{"$resource":"r' || page_id || '"}}]}') AS json FROM pages""",
    "kruskal_tree": f"{_KRUSKAL} SELECT * FROM tr",
    "graph_json_text": f"""{_KRUSKAL}, nd AS (SELECT probe_id, node, row_number() OVER (PARTITION BY probe_id ORDER BY node) - 1 AS number FROM (
      SELECT probe_id, src AS node FROM tr UNION SELECT probe_id, dst FROM tr UNION SELECT probe_id, 0 FROM tr)
    ), ln AS (SELECT tr.probe_id, a.number AS source, b.number AS target, round(weight, 3) AS w FROM tr JOIN nd a ON a.probe_id = tr.probe_id AND a.node = src JOIN nd b ON b.probe_id = tr.probe_id AND b.node = dst
    ), nj AS (SELECT probe_id, list({{'id': 'id' || number, 'file': 'world/' || node || '.jpg', 'fileid': node::VARCHAR, 'nodeConfidenceScore': 1.0::DOUBLE}} ORDER BY number) AS nodes FROM nd GROUP BY probe_id
    ), lj AS (SELECT probe_id, list({{'source': source, 'target': target, 'relationshipConfidenceScore': w}} ORDER BY source, target) AS links FROM ln GROUP BY probe_id)
    SELECT probe_id, to_json({{'directed': true, 'nodes': nodes, 'links': links}})::VARCHAR AS graph FROM nj JOIN lj USING (probe_id)""",
    "query_matrix_ids": f"WITH {SQL_D} SELECT dense_rank() OVER (ORDER BY image_id) - 1 AS qid, kp_idx, row_number() OVER (ORDER BY image_id, kp_idx) - 1 AS row FROM d WHERE version = 1",
    "graph_associations": f"{_TREE} SELECT family, src || '.jpg' AS source, dst || '.jpg' AS target, weight AS score FROM tree WHERE src % 4 <> 2 AND dst % 4 <> 2",
    "graph_node_renumber": f"""{_TREE}, n AS (SELECT family, src AS node FROM tree UNION SELECT family, dst FROM tree UNION SELECT family, 0 FROM tree)
    SELECT family, node, row_number() OVER (PARTITION BY family ORDER BY node) - 1 AS number FROM n""",
    "graph_first_seen": f"""{_TREE}, o AS (SELECT family, src, dst, row_number() OVER (PARTITION BY family ORDER BY dst DESC) - 1 AS pos FROM tree
    ), s AS (SELECT family, 'n' || src AS name, 2 * pos AS k FROM o UNION ALL SELECT family, 'n' || dst, 2 * pos + 1 FROM o), f AS (SELECT family, name, min(k) AS k FROM s GROUP BY ALL)
    SELECT family, name, row_number() OVER (PARTITION BY family ORDER BY k) - 1 AS number FROM f""",
    "journal_chain": f"""{images.SQL_LINKS}, l AS (SELECT i AS source, min(j) AS target FROM links WHERE i < j GROUP BY i
    ), c AS (WITH RECURSIVE w(start, step, node) AS (SELECT source, 0::BIGINT, source FROM l WHERE source % 4 = 0 UNION ALL SELECT start, step + 1, target FROM w JOIN l ON source = node) SELECT * FROM w)
    SELECT * FROM c""",
    "originals_and_modified": f"{images.SQL_LINKS} SELECT i, j FROM links WHERE i % 4 <> 3 AND j % 4 <> 3",
}
