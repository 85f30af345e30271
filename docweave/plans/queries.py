"""The registered queries of the document operators, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes, text
from ..functions.folds import unfold
from ..operators import blocks, cleaning, crosspage, evaluation, judge, render, tree, verify
from ..sources import content_json
from ..sources import tables as T
from . import pipeline

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# ---- SQL of the derived inputs. ----
LINES = """lines AS (
  SELECT doc_id, (generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1)::BIGINT AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents
), line_blocks AS (SELECT *, pos // 40 + 1 AS page_id, (pos % 40) * 20 + 10.0::DOUBLE AS y1, (pos % 40) * 20 + 22.0::DOUBLE AS y2 FROM lines)"""
HEADINGS = """hr AS (
  SELECT r_regionkey AS doc_id, 0 AS a, 0 AS b, (r_regionkey + 1) || '. ' || r_name AS text FROM region
  UNION ALL SELECT n_regionkey, n_nationkey + 1, 0, (n_regionkey + 1) || '.' || (n_nationkey + 1) || ' ' || n_name FROM nation
  UNION ALL SELECT n_regionkey, n_nationkey + 1, c_custkey + 1, (n_regionkey + 1) || '.' || (n_nationkey + 1) || '.' || c_custkey || ' ' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey
), headings AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) AS pos,
  CASE WHEN b > 0 THEN 3 WHEN a > 0 THEN 2 ELSE 1 END AS level, split_part(text, ' ', 1) AS number FROM hr)"""
# The numbering itself says what a heading's parent is.
NUMBERED = """hn AS (SELECT *, regexp_replace(rtrim(number, '.'), '\\.?[0-9]+$', '') AS up FROM headings),
parents AS (SELECT c.doc_id, c.pos, c.text, c.level, p.pos AS parent_pos, p.text AS parent_text FROM hn c LEFT JOIN hn p ON p.doc_id = c.doc_id AND p.level = c.level - 1 AND rtrim(p.number, '.') = c.up)"""
ELEMENTS = rf"""el AS (
  SELECT page_id AS doc_id, generate_subscripts(regexp_extract_all(coalesce(html, ''), '{T.ELEMENT}', 1), 1) - 1 AS pos,
    unnest(regexp_extract_all(coalesce(html, ''), '{T.ELEMENT}', 1)) AS tag, unnest(regexp_extract_all(coalesce(html, ''), '{T.ELEMENT}', 2)) AS text FROM pages
), elements AS (SELECT *, CASE WHEN tag IN ('title', 'h1') THEN 'title' WHEN tag IN ('li', 'a') THEN 'list' ELSE 'paragraph' END AS kind,
  CASE WHEN tag = 'footer' THEN 820.0 ELSE least(50.0 + pos * 10, 790.0) END::DOUBLE AS y1 FROM el)"""
BOXES = """lb AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, (l_linenumber - 1) // 3 + 1 AS page_id, (l_partkey % 600 - 5)::DOUBLE AS x1, (l_suppkey * 7 % 850)::DOUBLE AS y1,
  l_quantity, l_partkey, CASE l_linenumber % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'table' WHEN 2 THEN 'image' WHEN 3 THEN 'caption' ELSE 'paragraph' END AS kind,
  CASE WHEN l_returnflag = 'R' THEN '' ELSE l_linestatus END AS text FROM lineitem
), boxes AS (SELECT *, x1 + l_quantity - 1 AS x2, y1 + floor(l_quantity / 2) AS y2, CASE WHEN kind = 'title' THEN l_partkey % 9 END AS level FROM lb)"""
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SPACE = r"[\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]"
UNICODE_STRIP = f"regexp_replace({{0}}, '^{SPACE}+|{SPACE}+$', '', 'g')"
SPACE = SPACE.format()
NORMAL = STRIP.format(r"regexp_replace(regexp_replace(regexp_replace({0}, '\r\n|\r', chr(10), 'g'), '[ \t\f\v]*\n[ \t\f\v]*', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
#: Each kind's pattern, as far as RE2 reads it like Java.
FIELD_SQL = {k: p.replace("\\s", SPACE) if "[：:" not in p else p for k, p in text.FIELDS.items()}


def query(sql: str | None = None, schema: str | None = None):
    """Register a query; ``schema`` fixes its columns and types."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*(F.col(c).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in schema.split(", ")))) if schema else df

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return add


@query(f"""WITH {ELEMENTS}, kept AS (SELECT * FROM elements WHERE NOT ((y1 + 8 < 842.0 * 0.05 OR y1 > 842.0 * (1 - 0.05)) AND length(text) < 50) AND text <> ''),
ch AS (SELECT *, last_value(CASE WHEN kind = 'title' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY y1, (kind <> 'title')::INT, pos ROWS UNBOUNDED PRECEDING) AS chapter FROM kept)
SELECT doc_id, coalesce('e' || chapter, 'root') AS section, kind AS node_type, count(*) AS n_nodes FROM ch GROUP BY ALL""", "doc_id long, section string, node_type string, n_nodes long")
def html_sections(spark, sf_dir):
    """Nodes of each type in each section of the web pages."""
    nodes = blocks.preprocess(T.page_elements(spark, sf_dir)).withColumn("y1", F.col("bbox")["y1"]).withColumn("node_type", F.when(F.col("block_type") == "title", "heading").otherwise(F.col("block_type"))).withColumnRenamed("block_id", "node_id")
    x = tree.attach_to_chapters(nodes)
    return x.groupBy("doc_id", F.coalesce("chapter_id", F.lit("root")).alias("section"), F.col("block_type").alias("node_type")).agg(F.count("*").alias("n_nodes"))


@query(f"WITH {LINES} SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY page_id, y1, pos) AS position FROM line_blocks", "doc_id long, pos long, position long")
def block_sort_position(spark, sf_dir):
    return blocks.reading_order(T.line_blocks(spark, sf_dir))


@query(f"""WITH {LINES}, h AS (SELECT *, greatest(842.0, max(y2) OVER (PARTITION BY doc_id, page_id)) AS h FROM line_blocks)
SELECT doc_id, page_id, count(*) AS kept FROM h WHERE NOT ((y2 < h * 0.05 OR y1 > h * (1 - 0.05)) AND length(text) < 50) AND text <> '' GROUP BY ALL""", "doc_id long, page_id long, kept long")
def noise_filter(spark, sf_dir):
    return blocks.without_noise(T.line_blocks(spark, sf_dir)).groupBy("doc_id", "page_id").agg(F.count("*").alias("kept"))


@query(f"SELECT doc_id, md5({NORMAL.format('text')}) AS h, length({NORMAL.format('text')}) AS n FROM documents", "doc_id long, h string, n long")
def text_normalize(spark, sf_dir):
    x = T.read(spark, sf_dir, "documents").withColumn("t", text.normalize_text(F.col("text")))
    return x.select("doc_id", F.md5("t").alias("h"), F.length("t").alias("n"))


@query(f"""WITH {ELEMENTS}, n AS (SELECT tag AS raw FROM elements UNION ALL SELECT role FROM conversations)
SELECT raw, CASE WHEN raw IN ('title') THEN 'title' WHEN raw IN ('p', 'b', 'footer') AND raw = 'footer' THEN 'paragraph' WHEN raw = 'li' THEN 'list' WHEN raw = 'a' THEN 'paragraph' WHEN raw = 'b' THEN 'table' WHEN raw = 'p' THEN 'paragraph' ELSE 'paragraph' END AS kind, count(*) AS n FROM n GROUP BY ALL""", "raw string, kind string, n long")
def type_normalize(spark, sf_dir):
    raw = T.page_elements(spark, sf_dir).select(F.col("tag").alias("raw")).union(T.read(spark, sf_dir, "conversations").select("role"))
    return raw.groupBy("raw").agg(F.count("*").alias("n")).withColumn("kind", text.normalize_type(F.col("raw")))


@query(f"""WITH {BOXES}, a AS (SELECT doc_id, pos, least(x1, x2) AS xa, greatest(x1, x2) AS xb, y1, y2, (y1 < y2 AND y2 > 421 AND y1 < 421) AS flip FROM boxes),
f AS (SELECT doc_id, pos, xa, xb, CASE WHEN flip THEN 842 - y2 ELSE y1 END AS ya, CASE WHEN flip THEN 842 - y1 ELSE y2 END AS yb FROM a),
s AS (SELECT *, (xa BETWEEN 0 AND 1 AND xb BETWEEN 0 AND 1 AND ya BETWEEN 0 AND 1 AND yb BETWEEN 0 AND 1) AS part FROM f)
SELECT doc_id, pos, greatest(0, least(CASE WHEN part THEN xa * 595 ELSE xa END, 595))::DOUBLE AS x1, greatest(0, least(CASE WHEN part THEN ya * 842 ELSE ya END, 842))::DOUBLE AS y1,
 greatest(0, least(CASE WHEN part THEN xb * 595 ELSE xb END, 595))::DOUBLE AS x2, greatest(0, least(CASE WHEN part THEN yb * 842 ELSE yb END, 842))::DOUBLE AS y2 FROM s""", "doc_id long, pos long, x1 double, y1 double, x2 double, y2 double")
def coord_align(spark, sf_dir):
    b = F.col("bbox")
    x = T.line_boxes(spark, sf_dir).withColumn("b", boxes.align(F.array(b["x1"], b["y1"], b["x2"], b["y2"]), F.lit(595.0), F.lit(842.0)))
    return x.select("doc_id", "pos", "b.*")


@query(f"WITH {BOXES} SELECT DISTINCT doc_id, page_id, greatest(595, max(x2 + 10) OVER w)::DOUBLE AS page_width, greatest(842, max(y2 + 10) OVER w)::DOUBLE AS page_height FROM boxes WINDOW w AS (PARTITION BY doc_id, page_id)", "doc_id long, page_id long, page_width double, page_height double")
def page_size_infer(spark, sf_dir):
    return blocks.with_page_size(T.line_boxes(spark, sf_dir)).select("doc_id", "page_id", "page_width", "page_height").distinct()


@query(f"""WITH {BOXES}, v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_id, round(x1, 1), round(y1, 1), kind ORDER BY pos) AS n FROM boxes WHERE x2 > x1 AND y2 > y1)
SELECT doc_id, pos, CASE WHEN kind = 'title' AND NOT coalesce(level BETWEEN 1 AND 6, false) THEN 1 ELSE coalesce(level, 0) END AS local_level, CASE WHEN kind = 'title' AND NOT coalesce(level BETWEEN 1 AND 6, false) THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM v WHERE n = 1""", "doc_id long, pos long, local_level long, confidence double")
def block_validate_dedup(spark, sf_dir):
    """Lines with the same order, number and corner are told apart by their place in the table, which the SQL leaves open."""
    return blocks.validate(T.line_boxes(spark, sf_dir), F.col("file"), F.col("row")).withColumn("local_level", F.coalesce("local_level", F.lit(0)))


@query(f"""WITH {BOXES} SELECT doc_id, pos FROM boxes WHERE x1 >= 0 AND y1 >= 0 AND x2 <= 596 AND y2 <= 843 AND (x2 - x1) * (y2 - y1) >= 1
AND (text <> '' OR kind IN ('image', 'table', 'formula')) AND (kind <> 'title' OR coalesce(level BETWEEN 1 AND 6, false))""", "doc_id long, pos long")
def block_filter(spark, sf_dir):
    return blocks.inside_page(T.line_boxes(spark, sf_dir), F.lit(595.0), F.lit(842.0))


@query(f"""WITH {BOXES}, p AS (SELECT a.doc_id, a.pos AS left_pos, b.pos AS right_pos, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS w, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS h,
 (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.pos < b.pos)
SELECT doc_id, left_pos, right_pos, w > 0 AND h > 0 AS overlaps, CASE WHEN w > 0 AND h > 0 AND s - w * h > 0 THEN round(w * h / (s - w * h), 6) ELSE 0 END::DOUBLE AS iou FROM p""", "doc_id long, left_pos long, right_pos long, overlaps boolean, iou double")
def bbox_iou(spark, sf_dir):
    x = T.line_boxes(spark, sf_dir).select("doc_id", "pos", "bbox")
    pairs = x.select("doc_id", F.col("pos").alias("left_pos"), F.col("bbox").alias("a")).join(x.select("doc_id", F.col("pos").alias("right_pos"), F.col("bbox").alias("b")), "doc_id").where("left_pos < right_pos")
    return pairs.select("doc_id", "left_pos", "right_pos", boxes.overlaps(F.col("a"), F.col("b")).alias("overlaps"), F.round(boxes.iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query(f"WITH {HEADINGS} SELECT doc_id, pos, level, rtrim(number, '.') AS number FROM headings", "doc_id long, pos long, level long, number string")
def heading_numbering(spark, sf_dir):
    return T.headings(spark, sf_dir).select("doc_id", "pos", text.numbering(F.col("text")).alias("n")).select("doc_id", "pos", "n.*")


@query(f"WITH {HEADINGS} SELECT level, count(*) AS n FROM headings GROUP BY level", "level long, n long")
def heading_level_resolve(spark, sf_dir):
    return tree.resolve_levels(T.headings(spark, sf_dir)).groupBy("level").agg(F.count("*").alias("n"))


@query(f"WITH {HEADINGS}, {NUMBERED} SELECT doc_id, pos, 'h' || parent_pos AS parent_id FROM parents", "doc_id long, pos long, parent_id string")
def heading_parent(spark, sf_dir):
    return tree.with_parent(tree.resolve_levels(T.headings(spark, sf_dir)))


@query(f"""WITH {HEADINGS}, {NUMBERED} SELECT c.doc_id, c.pos, c.level AS depth, concat_ws(' > ', g.parent_text, c.parent_text, c.text) AS path
FROM parents c LEFT JOIN parents g ON g.doc_id = c.doc_id AND g.pos = c.parent_pos""", "doc_id long, pos long, depth long, path string")
def heading_ancestor_path(spark, sf_dir):
    x = tree.with_ancestors(tree.resolve_levels(T.headings(spark, sf_dir)), "text")
    return x.select("doc_id", "pos", (F.size("ancestors") + 1).alias("depth"), F.concat_ws(" > ", F.transform("ancestors", lambda a: a["text"]), "text").alias("path"))


@query(f"WITH {HEADINGS} SELECT doc_id, 'h' || pos AS node_id, pos AS preorder, level AS depth FROM headings", "doc_id long, node_id string, preorder long, depth long")
def tree_preorder(spark, sf_dir):
    x = T.headings(spark, sf_dir).select("doc_id", "pos", "page_id", F.col("node_id").alias("block_id"), boxes.box(F.lit(0), F.col("pos"), F.lit(10), F.col("pos") + 1).alias("bbox"), F.lit("title").alias("block_type"), F.lit(None).cast("int").alias("local_level"), "text", F.lit(0.9).alias("confidence"), F.lit("mock-headings").alias("model_version"))
    return tree.build_tree(x)


@query(f"""WITH {ELEMENTS} SELECT doc_id, pos, 'e' || last_value(CASE WHEN kind = 'title' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY y1, (kind <> 'title')::INT, pos ROWS UNBOUNDED PRECEDING) AS chapter_id FROM elements""", "doc_id long, pos long, chapter_id string")
def chapter_attach(spark, sf_dir):
    x = T.page_elements(spark, sf_dir).withColumn("y1", F.col("bbox")["y1"]).withColumn("node_type", F.when(F.col("block_type") == "title", "heading").otherwise(F.col("block_type"))).withColumnRenamed("block_id", "node_id")
    return tree.attach_to_chapters(x)


KEPT = "kept AS (SELECT * FROM elements WHERE NOT ((y1 + 8 < 842.0 * 0.05 OR y1 > 842.0 * (1 - 0.05)) AND length(text) < 50) AND text <> '')"


@query(f"""WITH {ELEMENTS}, {KEPT}, c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y1, pos) AS place,
 last_value(CASE WHEN kind = 'title' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY y1, (kind <> 'title')::INT, pos ROWS UNBOUNDED PRECEDING) AS chapter FROM kept)
SELECT doc_id, 'e' || pos AS node_id, CASE WHEN kind <> 'title' THEN 'e' || chapter END AS parent_id, CASE WHEN kind = 'title' THEN 'heading' ELSE kind END AS node_type, CASE WHEN kind = 'title' OR chapter IS NULL THEN 1 ELSE 2 END AS depth,
 row_number() OVER (PARTITION BY doc_id ORDER BY (kind <> 'title' AND chapter IS NULL)::INT, CASE WHEN kind = 'title' THEN pos ELSE chapter END, (kind <> 'title')::INT, CASE WHEN kind <> 'title' THEN place END) AS preorder FROM c""",
       "doc_id long, node_id string, parent_id string, node_type string, depth long, preorder long")
def document_tree(spark, sf_dir):
    """Whole trees of the web pages: parents, depths and reading order."""
    return tree.build_tree(blocks.preprocess(T.page_elements(spark, sf_dir)))


@query("SELECT doc_id, substr(sha1(coalesce(text, '')), 1, 16) AS content_hash FROM documents", "doc_id long, content_hash string")
def content_hash(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query(f"""WITH {HEADINGS}, {NUMBERED}, r AS (SELECT doc_id, concat_ws(chr(31), 'h' || pos, coalesce('h' || parent_pos, 'root'), 'heading', substr(sha1(text), 1, 16)) AS r FROM parents)
SELECT doc_id, substr(sha1(string_agg(r, chr(30) ORDER BY r)), 1, 16) AS tree_hash, count(*) AS n_nodes FROM r GROUP BY doc_id""", "doc_id long, tree_hash string, n_nodes long")
def tree_hash(spark, sf_dir):
    x = tree.with_parent(tree.resolve_levels(T.headings(spark, sf_dir))).withColumn("node_type", F.lit("heading")).withColumn("content_hash", text.content_hash(F.col("text")))
    return tree.tree_hash(x)


@query(f"""WITH {BOXES}, p AS (SELECT a.doc_id, a.pos, b.pos AS other, sqrt(pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)) AS d FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.kind = 'table' AND b.kind = 'image'),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY d, other) AS n FROM p) SELECT doc_id, 'l' || pos AS node_id, 'l' || other AS object_id, round(d, 4) AS distance FROM r WHERE n = 1""", "doc_id long, node_id string, object_id string, distance double")
def nearest_table(spark, sf_dir):
    x = T.line_boxes(spark, sf_dir)
    objects = x.where("block_type = 'image'").select("doc_id", "pos", F.col("block_id").alias("object_id"), "page_id", "bbox", F.lit(1).alias("row_count"), F.lit(1).alias("col_count"), F.array(F.array("text")).alias("cell_matrix"))
    found = tree.nearest_tables(x.where("block_type = 'table'").withColumnRenamed("block_id", "node_id"), objects)
    return found.withColumn("distance", F.round("distance", 4))


TABLES = """nt AS (SELECT n_regionkey AS doc_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) // 2 AS t, n_nationkey, n_name FROM nation),
tabs AS (SELECT doc_id, t, count(*) + 1 AS rows, string_agg(n_nationkey || '|' || n_name, ';' ORDER BY n_nationkey) AS body, CASE WHEN t < 2 THEN 'nation name' ELSE 'state name' END AS head FROM nt GROUP BY ALL)"""


@query(f"""WITH {TABLES}, h AS (SELECT r_regionkey AS doc_id, unnest([1, 2]) AS page_id FROM region WHERE r_regionkey > 0)
SELECT t.doc_id, t.t AS pos, t.rows AS row_count, (SELECT 'h' || max(h.page_id) FROM h WHERE h.doc_id = t.doc_id AND h.page_id <= t.t + 1) AS parent_id FROM tabs t WHERE t.t > 0""", "doc_id long, pos long, row_count long, parent_id string")
def missing_table_nodes(spark, sf_dir):
    """Tables without a node (all but each region's first), under the latest heading so far; the first region has none."""
    found = T.nation_tables(spark, sf_dir)
    heads = T.read(spark, sf_dir, "region").where("r_regionkey > 0").select(F.col("r_regionkey").alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("page_id"))
    heads = heads.select("doc_id", "page_id", F.col("page_id").alias("pos"), F.concat(F.lit("h"), F.col("page_id").cast("string")).alias("node_id"))
    return tree.missing_tables(found.where("pos = 0").select("doc_id", "cell_matrix"), found, heads)


@query(schema="doc_id long, image_id string, caption_id string, need_review boolean")
def image_caption_pairs(spark, sf_dir):
    return tree.pair_captions(T.line_boxes(spark, sf_dir).withColumnRenamed("block_id", "node_id").withColumnRenamed("block_type", "node_type"))


@query(f"""WITH wl AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, i // 6 // 4 + 1 AS page_id, i // 6 AS pos, array_to_string(w[i + 1:i + 12], ' ') AS text FROM (SELECT *, unnest(range(0, len(w), 6)) AS i FROM wl)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY pos) AS a, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY pos DESC) AS z FROM f),
k AS (SELECT *, list_distinct(list_concat([w FOR w IN string_split_regex(lower({UNICODE_STRIP.format('text')}), '{SPACE}+') IF length(w) > 1], regexp_extract_all(text, '[一-鿿]'))) AS w,
 right(regexp_replace(text, '{SPACE}+$', ''), 1) IN ({', '.join(f"'{x}'" for x in text.SENTENCE_ENDS)}) AS ends FROM r WHERE a <= 3 OR z <= 3),
p AS (SELECT t.doc_id, t.pos AS tail_pos, h.pos AS head_pos, row_number() OVER (PARTITION BY t.doc_id, t.pos ORDER BY h.pos) AS n FROM k t JOIN k h ON h.doc_id = t.doc_id AND h.page_id = t.page_id + 1 AND t.z <= 3 AND h.a <= 3
 WHERE NOT t.ends AND t.text <> '' AND h.text <> '' AND len(t.w) > 0 AND len(h.w) > 0 AND len(list_intersect(t.w, h.w)) / len(list_distinct(list_concat(t.w, h.w))) >= 0.3)
SELECT doc_id, tail_pos, head_pos FROM p WHERE n = 1""", "doc_id long, tail_pos long, head_pos long")
def cross_page_paragraphs(spark, sf_dir):
    """The documents in lines of twelve words, the last six of each of which begin the next, on pages of four lines."""
    word = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    d = T.read(spark, sf_dir, "documents").select("doc_id", word.alias("w")).where("size(w) > 0")
    lines = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(6)), lambda i: F.array_join(F.slice("w", i + 1, F.lit(12)), " "))
    x = d.select("doc_id", F.posexplode(lines).alias("pos", "text")).withColumn("page_id", (F.floor(F.col("pos") / 4) + 1).cast("int"))
    x = x.withColumn("block_id", F.concat(F.lit("b"), F.col("pos").cast("string"))).withColumn("block_type", F.lit("paragraph")).withColumn("bbox", boxes.box(F.lit(50), F.col("pos") % 4, F.lit(545), F.col("pos") % 4 + 1))
    return crosspage.split_paragraphs(x)


@query("""WITH o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, 50 + o_orderkey % 3 * 20 AS x1 FROM orders),
p AS (SELECT *, (pos - 1) // 7 + 1 AS page, count(*) OVER (PARTITION BY doc_id, (pos - 1) // 7) AS size FROM o)
SELECT t.doc_id, t.pos AS tail_pos, h.pos AS head_pos FROM p t JOIN p h ON h.doc_id = t.doc_id AND h.page = t.page + 1 AND h.pos = t.pos + 1 AND abs(t.x1 - h.x1) < 30""", "doc_id long, tail_pos long, head_pos long")
def cross_page_lists(spark, sf_dir):
    return crosspage.split_lists(T.order_lists(spark, sf_dir))


@query(f"WITH {TABLES} SELECT a.doc_id, 't' || a.t AS upper_id, 't' || b.t AS lower_id, 1.0::DOUBLE AS overlap FROM tabs a JOIN tabs b ON a.doc_id = b.doc_id AND b.t = a.t + 1 AND a.head = b.head", "doc_id long, upper_id string, lower_id string, overlap double")
def cross_page_tables(spark, sf_dir):
    return crosspage.split_tables(T.nation_tables(spark, sf_dir))


def _fields(column: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest([{UNICODE_STRIP.format('v')} FOR v IN regexp_extract_all(coalesce({column}, ''), '{p}')]) AS value FROM documents" for k, p in FIELD_SQL.items())


@query(_fields("text"), "doc_id long, kind string, value string")
def critical_fields(spark, sf_dir):
    """The fields of all six kinds."""
    x = T.read(spark, sf_dir, "documents")
    return x.select("doc_id", F.explode(text.critical_fields(F.col("text"))).alias("f")).select("doc_id", "f.*")


@query(f"""WITH l AS (SELECT doc_id, kind, value, count(*) AS n FROM ({_fields("text")}) GROUP BY ALL), r AS (SELECT doc_id, kind, value, count(*) AS m FROM ({_fields("translate(text, '9', '8')")}) GROUP BY ALL)
SELECT doc_id, kind, value, substr(repeat(', ' || value, n), 3) AS left_value, substr(repeat(', ' || value, coalesce(m, 0)), 3) AS right_value, 'vlm_vs_pdf' AS source, 'adopted_pdf' AS resolution FROM l LEFT JOIN r USING (doc_id, kind, value) WHERE n <> coalesce(m, 0)""",
       "doc_id long, kind string, value string, left_value string, right_value string, source string, resolution string")
def critical_field_conflicts(spark, sf_dir):
    """Fields of the documents against a copy in which nines became eights."""
    x = T.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("vlm_text"), F.translate(F.coalesce("text", F.lit("")), "9", "8").alias("pdf_text"))
    return verify.verify_fields(x)


@query(f"""WITH {LINES}, b AS (SELECT doc_id, pos, k, pos % 40 AS place FROM (SELECT doc_id, pos, {UNICODE_STRIP.format('text')} AS k, text FROM lines) WHERE text <> ''),
n AS (SELECT *, row_number() OVER w AS n FROM b WINDOW w AS (PARTITION BY doc_id, k, place ORDER BY pos)),
s AS (SELECT doc_id, pos, k, place, row_number() OVER (PARTITION BY doc_id, k, place ORDER BY pos) AS n FROM b WHERE pos % 3 <> 0 AND k <> '')
SELECT n.doc_id, 'b' || n.pos AS block_id, coalesce('b' || s.pos, '') AS object_id, CASE WHEN s.pos IS NULL THEN 'none' ELSE 'strong' END AS level, CASE WHEN s.pos IS NULL THEN 0 ELSE 1 END::DOUBLE AS confidence FROM n LEFT JOIN s USING (doc_id, k, place, n)""",
       "doc_id long, block_id string, object_id string, level string, confidence double")
def text_align_exact(spark, sf_dir):
    """Lines of the documents against the same lines with every third one missing."""
    x = T.line_blocks(spark, sf_dir)
    return verify.align(x, x.where("pos % 3 <> 0").withColumn("object_id", F.col("block_id")))


def _fuzzy(spark, sf_dir):
    x = T.page_elements(spark, sf_dir)
    spans = x.where("pos % 4 <> 0").withColumn("object_id", F.col("block_id")).withColumn("text", F.translate("text", "e", "a"))
    return verify.align(x, spans)


@query(schema="doc_id long, block_id string, object_id string, similarity double, overlap boolean, level string, confidence double")
def text_align_fuzzy(spark, sf_dir):
    """All elements of the web pages against a garbled copy of them."""
    return _fuzzy(spark, sf_dir)


@query(schema="doc_id long, total long, strong long, weak long, none long")
def align_level_counts(spark, sf_dir):
    return verify.level_counts(_fuzzy(spark, sf_dir))


@query(f"WITH {ELEMENTS}, c AS (SELECT kind, count(*) AS n FROM elements GROUP BY kind) SELECT k.kind, coalesce(c.n, 0) AS n FROM (VALUES ('title'), ('paragraph'), ('list'), ('table')) k(kind) LEFT JOIN c USING (kind)", "kind string, n long")
def object_kind_counts(spark, sf_dir):
    return evaluation.kind_counts(T.page_elements(spark, sf_dir).withColumn("kind", F.col("block_type")), ("title", "paragraph", "list", "table"))


@query("SELECT source, round(avg((quality = 0)::INT), 6) AS review_ratio FROM documents JOIN labels USING (doc_id) GROUP BY source", "source string, review_ratio double")
def review_ratio(spark, sf_dir):
    x = T.read(spark, sf_dir, "documents").select("doc_id", "source").join(T.read(spark, sf_dir, "labels"), "doc_id").withColumn("need_review", F.col("quality") == 0)
    return evaluation.review_ratio(x, "source").withColumn("review_ratio", F.round("review_ratio", 6))


def _chains(spark, sf_dir):
    x = tree.with_ancestors(tree.resolve_levels(T.headings(spark, sf_dir)), "text")
    return x.select("doc_id", "pos", "text", F.transform("ancestors", lambda a: a["text"]).alias("chain"))


@query(f"WITH {HEADINGS} SELECT doc_id, round(avg((NOT (level = 3 AND pos % 5 = 0))::INT), 6) AS heading_level_accuracy FROM headings GROUP BY doc_id", "doc_id long, heading_level_accuracy double")
def heading_accuracy(spark, sf_dir):
    """Headings against a copy in which every fifth leaf lost its parent."""
    truth = _chains(spark, sf_dir)
    wrong = truth.withColumn("chain", F.when((F.size("chain") == 2) & (F.col("pos") % 5 == 0), F.slice("chain", 1, 1)).otherwise(F.col("chain")))
    return evaluation.heading_accuracy(wrong, truth).withColumn("heading_level_accuracy", F.round("heading_level_accuracy", 6))


def _pairs(spark, sf_dir):
    return _chains(spark, sf_dir).select("doc_id", "pos", F.coalesce(F.try_element_at("chain", F.lit(-1)), F.lit("root")).alias("parent"), F.col("text").alias("child"))


@query(f"WITH {HEADINGS}, n AS (SELECT doc_id, count(*) AS t, count(*) FILTER (pos % 7 <> 0) AS p FROM headings GROUP BY doc_id) SELECT doc_id, 1.0::DOUBLE AS precision, round(p / t, 6) AS recall, round(2 * p / (p + t), 6) AS parent_child_f1 FROM n", "doc_id long, precision double, recall double, parent_child_f1 double")
def parent_child_f1(spark, sf_dir):
    truth = _pairs(spark, sf_dir)
    x = evaluation.pair_f1(truth.where("pos % 7 <> 0"), truth, name="parent_child_f1")
    return x.withColumn("recall", F.round("recall", 6)).withColumn("parent_child_f1", F.round("parent_child_f1", 6))


@query(f"WITH {HEADINGS}, n AS (SELECT doc_id, count(*) AS t, count(*) FILTER (pos % 7 <> 0) AS p FROM headings GROUP BY doc_id) SELECT doc_id, round(2 * p / (p + t), 6) AS pc_f1_root FROM n", "doc_id long, pc_f1_root double")
def pc_f1_root(spark, sf_dir):
    """The variant that pairs every heading with the root."""
    truth = _pairs(spark, sf_dir).withColumn("parent", F.lit("root"))
    return evaluation.pair_f1(truth.where("pos % 7 <> 0"), truth, name="pc_f1_root").withColumn("pc_f1_root", F.round("pc_f1_root", 6))


@query("""WITH e AS (SELECT user_id AS doc_id, event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events),
k AS (SELECT a.doc_id, avg(CASE WHEN (a.p < b.p) = (a.t < b.t) THEN 1.0 ELSE -1.0 END) AS tau FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.item < b.item GROUP BY a.doc_id)
SELECT doc_id, round(coalesce(tau, 1.0), 6)::DOUBLE AS reading_order_kendall_tau FROM (SELECT DISTINCT doc_id FROM e) LEFT JOIN k USING (doc_id)""", "doc_id long, reading_order_kendall_tau double")
def kendall_tau(spark, sf_dir):
    """Each user's events by value against their order in time."""
    e = T.read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("item"), "ts", "value")
    by = lambda c: e.select("doc_id", "item", F.row_number().over(Window.partitionBy("doc_id").orderBy(c, "item")).alias("pos"))
    return evaluation.kendall_tau(by("value"), by("ts")).withColumn("reading_order_kendall_tau", F.round("reading_order_kendall_tau", 6))


@query(f"""WITH {TABLES}, c AS (SELECT doc_id, t, 2 * rows AS t_cells, sum((n_nationkey % 4 <> 0)::INT) AS same FROM nt JOIN tabs USING (doc_id, t) GROUP BY ALL)
SELECT doc_id, t AS pos, round((t_cells - (t_cells / 2 - 1 - same)) / t_cells, 6)::DOUBLE AS f1 FROM c""", "doc_id long, pos long, f1 double")
def table_cell_f1(spark, sf_dir):
    """Tables against a copy in which names of every fourth nation are changed."""
    t = T.nation_tables(spark, sf_dir)
    garbled = F.transform("cell_matrix", lambda r: F.when(F.try_element_at(r, F.lit(1)).try_cast("int") % 4 == 0, F.array(r[0], F.lit("?"))).otherwise(r))
    return evaluation.cell_f1(t.withColumn("cell_matrix", garbled), t, "doc_id", "pos").withColumn("f1", F.round("f1", 6))


@query(f"""WITH {TABLES}, k AS (SELECT doc_id, count(*) FILTER (head = 'nation name') AS a, count(*) FILTER (head = 'state name') AS b FROM tabs GROUP BY doc_id)
SELECT doc_id, round((CASE WHEN a > 0 THEN 1 ELSE 0 END) / ((CASE WHEN a > 0 THEN 1 ELSE 0 END) + b), 6)::DOUBLE AS table_cell_f1 FROM k""", "doc_id long, table_cell_f1 double")
def table_pairing(spark, sf_dir):
    """Each region's first table alone against all of its tables."""
    t = T.nation_tables(spark, sf_dir)
    return evaluation.paired_table_f1(t.where("pos = 0"), t).withColumn("table_cell_f1", F.round("table_cell_f1", 6))


@query("""SELECT p_partkey, round(levenshtein(trim(replace(p_name, 'a', 'oo')), trim(p_name)) / length(trim(p_name)), 6)::DOUBLE AS text_cer FROM part""", "p_partkey long, text_cer double")
def cer(spark, sf_dir):
    x = T.read(spark, sf_dir, "part")
    return x.select("p_partkey", F.round(evaluation.cer(F.replace("p_name", F.lit("a"), F.lit("oo")), F.col("p_name")), 6).alias("text_cer"))


def _results(spark, sf_dir):
    """The trees of the web pages against their elements as they stand in the source, by hosts' kinds of dirt."""
    x = T.page_elements(spark, sf_dir)
    heading = F.col("block_type") == "title"
    truth = x.select("doc_id", "pos", F.col("block_id").alias("id"), F.when(heading, "heading").otherwise(F.col("block_type")).alias("type"), "text", F.lit(None).cast("string").alias("parent_id"))
    level = F.element_at(F.array(F.lit("light"), F.lit("medium"), F.lit("heavy")), (F.col("doc_id") % 3 + 1).cast("int"))
    nodes = tree.build_tree(blocks.preprocess(x))
    return evaluation.evaluate_trees(nodes, truth, x.select("doc_id", level.alias("dirt_level")).distinct())


RESULTS = f"""{ELEMENTS}, {KEPT}, ch AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y1, pos) AS place,
 last_value(CASE WHEN kind = 'title' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY y1, (kind <> 'title')::INT, pos ROWS UNBOUNDED PRECEDING) AS chapter FROM kept),
tr AS (SELECT doc_id, pos, kind, {NORMAL.format('text')} AS text, row_number() OVER (PARTITION BY doc_id ORDER BY (kind <> 'title' AND chapter IS NULL)::INT, CASE WHEN kind = 'title' THEN pos ELSE chapter END, (kind <> 'title')::INT, CASE WHEN kind <> 'title' THEN place END) AS preorder FROM ch),
th AS (SELECT DISTINCT doc_id, {UNICODE_STRIP.format('text')} AS h FROM elements WHERE kind = 'title' AND {UNICODE_STRIP.format('text')} <> ''),
ph AS (SELECT DISTINCT doc_id, {UNICODE_STRIP.format('text')} AS h FROM kept WHERE kind = 'title' AND {UNICODE_STRIP.format('text')} <> ''),
he AS (SELECT doc_id, avg((p.h IS NOT NULL)::INT) AS acc, count(p.h) AS tp, count(*) AS nt FROM th LEFT JOIN ph p USING (doc_id, h) GROUP BY doc_id), np AS (SELECT doc_id, count(*) AS np FROM ph GROUP BY doc_id),
ti AS (SELECT doc_id, coalesce(nullif(text, ''), 'e' || pos) AS item, max(pos) AS t FROM elements GROUP BY ALL),
pi AS (SELECT doc_id, preorder, t, min(preorder) OVER (PARTITION BY doc_id, item) AS p FROM (SELECT doc_id, preorder, text AS item FROM tr WHERE text <> '') JOIN ti USING (doc_id, item)),
ta AS (SELECT a.doc_id, avg(CASE WHEN CASE WHEN a.t < b.t THEN a.p < b.p ELSE a.p > b.p END THEN 1.0 ELSE -1.0 END) AS tau, count(DISTINCT a.t) AS n FROM pi a JOIN pi b ON a.doc_id = b.doc_id AND a.preorder < b.preorder GROUP BY a.doc_id),
sa AS (SELECT doc_id, string_agg(text, ' ' ORDER BY pos) FILTER (text <> '') AS said FROM elements GROUP BY doc_id), sk AS (SELECT doc_id, string_agg(text, ' ' ORDER BY pos) AS said FROM tr GROUP BY doc_id),
ce AS (SELECT doc_id, trim(regexp_replace(coalesce(sk.said, ''), '{SPACE}+', ' ', 'g')) AS p, trim(regexp_replace(coalesce(sa.said, ''), '{SPACE}+', ' ', 'g')) AS t FROM sa LEFT JOIN sk USING (doc_id)),
res AS (SELECT doc_id, ['light', 'medium', 'heavy'][doc_id % 3 + 1] AS dirt_level, coalesce(acc, 1)::DOUBLE AS heading_level_accuracy, coalesce(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (nt + np) END, 1)::DOUBLE AS parent_child_f1,
 CASE WHEN n > 0 THEN tau ELSE 1 END::DOUBLE AS reading_order_kendall_tau, 1::DOUBLE AS table_cell_f1, CASE WHEN t = '' THEN (p <> '')::INT WHEN p = '' THEN 1 ELSE (length(t) - length(p)) / length(t) END::DOUBLE AS text_cer, 0::DOUBLE AS review_ratio
 FROM (SELECT DISTINCT doc_id FROM elements) LEFT JOIN he USING (doc_id) LEFT JOIN np USING (doc_id) LEFT JOIN ta USING (doc_id) LEFT JOIN ce USING (doc_id))"""


@query(f"WITH {RESULTS} SELECT doc_id, dirt_level, {', '.join(f'round({m}, 6) AS {m}' for m in evaluation.METRICS)}, (heading_level_accuracy < 1)::INT + (parent_child_f1 < 1)::INT + (table_cell_f1 < 1)::INT + (text_cer > 0.05)::INT AS badcase_count FROM res",
       "doc_id long, dirt_level string, " + ", ".join(f"{m} double" for m in evaluation.METRICS) + ", badcase_count long")
def tree_evaluation(spark, sf_dir):
    return _results(spark, sf_dir).withColumns({m: F.round(m, 6) for m in evaluation.METRICS})


@query(f"""WITH {RESULTS} SELECT dirt_level, count(*) AS count, {', '.join(f'round(avg(coalesce({m}, 0)), 6)::DOUBLE AS {m}' for m in evaluation.METRICS)},
sum((heading_level_accuracy < 1)::INT + (parent_child_f1 < 1)::INT + (table_cell_f1 < 1)::INT + (text_cer > 0.05)::INT)::BIGINT AS badcase_total FROM res GROUP BY dirt_level""",
       "dirt_level string, count long, " + ", ".join(f"{m} double" for m in evaluation.METRICS) + ", badcase_total long")
def quality_report(spark, sf_dir):
    x = evaluation.report(_results(spark, sf_dir))
    return x.withColumns({m: F.round(m, 6) for m in evaluation.METRICS})


@query(f"WITH {RESULTS}, f AS (" + " UNION ALL ".join(f"SELECT dirt_level, '{k}' AS badcase FROM res WHERE coalesce({m}, {d}) {s} {v}" for k, (m, d, s, v) in evaluation.BADCASES.items()) + ") SELECT dirt_level, badcase, count(*) AS n FROM f GROUP BY ALL", "dirt_level string, badcase string, n long")
def badcase_classes(spark, sf_dir):
    return evaluation.badcases(_results(spark, sf_dir)).groupBy("dirt_level", "badcase").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES}, n AS (SELECT doc_id, count(*) AS total, sum(length(text))::BIGINT AS chars, coalesce(sum(length(text)) FILTER (pos % 10 <> 0), 0)::BIGINT AS seen FROM lines GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN chars = 0 THEN 1.0 ELSE least(1.0, seen / chars) END, 6)::DOUBLE AS text_recall FROM n""", "doc_id long, text_recall double")
def fidelity_recall(spark, sf_dir):
    """Characters of the documents' lines that remain when every tenth line is lost."""
    x = T.line_blocks(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.length("text")).alias("a"), F.coalesce(F.sum(F.when(F.col("pos") % 10 != 0, F.length("text"))), F.lit(0)).alias("b"))
    return x.select("doc_id", F.round(evaluation.recall(F.col("b"), F.col("a")), 6).alias("text_recall"))


@query(f"""WITH {LINES}, pg AS (SELECT doc_id, page_id, string_agg(text, chr(10) ORDER BY pos) AS body FROM line_blocks GROUP BY ALL),
p AS (SELECT doc_id, pos, page_id AS expected, {UNICODE_STRIP.format("substr(text, 1, 10)")} AS anchor FROM line_blocks WHERE {UNICODE_STRIP.format("text")} <> ''),
f AS (SELECT p.*, (SELECT min(pg.page_id) FROM pg WHERE pg.doc_id = p.doc_id AND p.anchor <> '' AND contains(pg.body, p.anchor)) AS found FROM p),
b AS (SELECT doc_id, coalesce(least(abs(expected - found), 5), 5) AS bucket FROM f)
SELECT doc_id, {', '.join(f'count(*) FILTER (bucket = {i}) AS off_{i}' for i in range(6))}, round(count(*) FILTER (bucket <= 1) / count(*), 6)::DOUBLE AS deviation_ratio FROM b GROUP BY doc_id""",
       "doc_id long, " + ", ".join(f"off_{i} long" for i in range(6)) + ", deviation_ratio double")
def page_deviation(spark, sf_dir):
    """Every line of the documents that isn't blank, looked up on their pages."""
    x = T.line_blocks(spark, sf_dir)
    pages = x.groupBy("doc_id", "page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), "\n").alias("text"))
    found = evaluation.anchor_pages(x.where(text.strip(text.text_of("text")) != "").select("doc_id", "pos", "text", F.col("page_id").alias("expected_page")), pages)
    return evaluation.page_deviation(found).withColumn("deviation_ratio", F.round("deviation_ratio", 6))


def _fidelity(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.element_at(F.array(F.lit("light"), F.lit("medium"), F.lit("heavy"), F.lit("other")), (F.col("doc_id") % 4 + 1).cast("int")).alias("dirt_level"), (1 - F.col("doc_id") % 5 / 200).alias("text_recall"), (1 - F.col("doc_id") % 3 / 80).alias("image_recall"), (1 - F.col("doc_id") % 7 / 40).alias("table_row_accuracy"), (1 - F.col("doc_id") % 9 / 30).alias("deviation_ratio"))


@query("""WITH g(level, g1, g2, g3, g4) AS (VALUES ('light', 0.99, 0.98, 0.97, 0.95), ('medium', 0.99, 0.98, 0.95, 0.90), ('heavy', 0.99, 0.98, 0.88, 0.80)),
f AS (SELECT doc_id, ['light', 'medium', 'heavy', 'medium'][doc_id % 4 + 1] AS level, 1 - doc_id % 5 / 200.0::DOUBLE AS a, 1 - doc_id % 3 / 80.0::DOUBLE AS b, 1 - doc_id % 7 / 40.0::DOUBLE AS c, 1 - doc_id % 9 / 30.0::DOUBLE AS d FROM documents)
SELECT doc_id, a >= g1::DOUBLE AS text_ok, b >= g2::DOUBLE AS image_ok, c >= g3::DOUBLE AS table_ok, d >= g4::DOUBLE AS deviation_ok, a >= g1::DOUBLE AND b >= g2::DOUBLE AND c >= g3::DOUBLE AND d >= g4::DOUBLE AS overall FROM f JOIN g USING (level)""",
       "doc_id long, text_ok boolean, image_ok boolean, table_ok boolean, deviation_ok boolean, overall boolean")
def go_no_go(spark, sf_dir):
    return evaluation.go_no_go(_fidelity(spark, sf_dir))


@query("SELECT conv_id AS doc_id, role AS task, count(*) AS n, (sum(count(*)) OVER w)::BIGINT AS total, greatest(0, 4 - sum(count(*)) OVER w)::BIGINT AS remaining, sum(count(*)) OVER w >= 4 AS exceeded FROM conversations GROUP BY conv_id, role WINDOW w AS (PARTITION BY conv_id)", "doc_id long, task string, n long, total long, remaining long, exceeded boolean")
def llm_cost(spark, sf_dir):
    """Turns of the conversations as calls, by role, against a budget of four."""
    return evaluation.call_costs(T.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("task")), 4)


def _content_lists(spark, sf_dir):
    """The elements of the web pages as provider files: (doc_id, content) with one page each."""
    x = T.page_elements(spark, sf_dir)
    b = F.col("bbox")
    item = F.struct(F.col("block_type").alias("type"), F.struct(F.col("text").alias("text"), F.lit(2).alias("level")).alias("content"), F.array(b["x1"], b["y1"], b["x2"], b["y2"]).alias("bbox"))
    items = F.transform(F.sort_array(F.collect_list(F.struct("pos", item.alias("i")))), lambda r: r["i"])
    return x.groupBy("doc_id").agg(F.to_json(F.array(items)).alias("content"))


CLEAN = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"


@query(f"""WITH {ELEMENTS}, n AS (SELECT doc_id, kind, {CLEAN} AS t FROM elements) SELECT doc_id, kind AS block_type, count(*) AS n, sum(length(t))::BIGINT AS n_chars, max(CASE WHEN kind = 'title' THEN 2 ELSE 0 END) AS level FROM n GROUP BY ALL""", "doc_id long, block_type string, n long, n_chars long, level long")
def content_list_parse(spark, sf_dir):
    """Provider files read back as blocks."""
    x = content_json.content_list_v2(_content_lists(spark, sf_dir))
    return x.groupBy("doc_id", "block_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"), F.coalesce(F.max("local_level"), F.lit(0)).alias("level"))


@query("""WITH o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_orderpriority AS p FROM orders)
SELECT doc_id, pos, CASE WHEN pos % 5 >= 4 OR pos % 4 = 0 THEN 'title' WHEN pos % 4 < 3 THEN 'list' ELSE 'paragraph' END AS block_type, CASE WHEN pos % 5 >= 4 THEN 1 WHEN pos % 4 = 0 THEN 2 END AS local_level,
 CASE pos % 4 WHEN 0 THEN pos || '.' || pos || ' ' || p WHEN 1 THEN pos || ') ' || p WHEN 2 THEN '- ' || p ELSE p END AS text FROM o""", "doc_id long, pos long, block_type string, local_level long, text string")
def rule_blocks(spark, sf_dir):
    """Orders as text objects of varying size, numbered as headings, as items or not at all, typed by rule."""
    x = T.order_lists(spark, sf_dir).withColumn("line", F.col("pos")).withColumn("font_size", (F.col("pos") % 5 + 10).cast("double"))
    n, said = F.col("pos").cast("string"), F.substring_index("text", ". ", -1)
    kind = F.col("pos") % 4
    x = x.withColumn("text", F.when(kind == 0, F.concat(n, F.lit("."), n, F.lit(" "), said)).when(kind == 1, F.concat(n, F.lit(") "), said)).when(kind == 2, F.concat(F.lit("- "), said)).otherwise(said))
    return content_json.rule_blocks(x)


@query(schema="rule string, n_changes long")
def xml_clean_counts(spark, sf_dir):
    """Lines of the documents in DOCX files, every third inserted, fourth deleted, fifth hidden, sixth with a comment, seventh struck, eighth with a field; macros in every second file."""
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    line = F.regexp_replace("text", r"[<&\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    n = F.col("pos")
    marks = F.concat(F.when(n % 5 == 0, "<w:vanish/>").otherwise(""), F.when(n % 7 == 0, "<w:strike/>").otherwise(""))
    run = F.concat(F.lit("<w:r><w:rPr>"), marks, F.lit("</w:rPr><w:t>"), line, F.lit("</w:t></w:r>"))
    run = F.when(n % 3 == 0, F.concat(F.lit("<w:ins>"), run, F.lit("</w:ins>"))).when(n % 4 == 0, F.concat(F.lit("<w:del>"), run, F.lit("</w:del>"))).otherwise(run)
    mark = '<w:r><w:fldChar w:fldCharType="{}"/></w:r>'.format
    field = mark("begin") + "<w:r><w:instrText>PAGE</w:instrText></w:r>" + mark("separate") + "<w:r><w:t>1</w:t></w:r>" + mark("end")
    more = F.concat(F.when(n % 6 == 0, '<w:commentRangeStart w:id="1"/>').otherwise(""), F.when(n % 8 == 0, field).otherwise(""))
    lines = T.line_blocks(spark, sf_dir).select("doc_id", "pos", F.concat(F.lit("<w:p>"), run, more, F.lit("</w:p>")).alias("p"))
    xml = lines.groupBy("doc_id").agg(F.concat(F.lit(f"<w:document {ns}><w:body>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "p"))), lambda r: r["p"]), ""), F.lit("</w:body></w:document>")).alias("xml"))

    def zipped(file):
        import io
        import zipfile

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", file["xml"])
            if file["macros"]:
                z.writestr("word/vbaProject.bin", "x")
        yield out.getvalue(),

    files = unfold(xml.select("doc_id", F.struct("xml", (F.col("doc_id") % 2 == 0).alias("macros")).alias("file")), "file", zipped, "content binary")
    return cleaning.changes_by_rule(cleaning.clean(files))


ORACLE_SQL["xml_clean_counts"] = f"""WITH {LINES}, m AS (SELECT *, pos % 3 <> 0 AND pos % 4 = 0 AS gone FROM lines)
SELECT 'accept_revisions' AS rule, count(*) FILTER (pos % 3 = 0 OR pos % 4 = 0) AS n_changes FROM m
UNION ALL SELECT 'remove_vanish', count(*) FILTER (NOT gone AND pos % 5 = 0) FROM m
UNION ALL SELECT 'remove_strikethrough', count(*) FILTER (NOT gone AND pos % 5 <> 0 AND pos % 7 = 0) FROM m
UNION ALL SELECT 'strip_comments', count(*) FILTER (pos % 6 = 0) FROM m UNION ALL SELECT 'freeze_fields', count(*) FILTER (pos % 8 = 0) FROM m
UNION ALL SELECT 'strip_macros', count(*) FILTER (doc_id % 2 = 0) FROM (SELECT DISTINCT doc_id FROM m)"""


@query(f"""WITH {ELEMENTS} SELECT CASE WHEN kind = 'title' THEN 'Heading1' WHEN kind = 'list' THEN 'ListParagraph' ELSE 'Normal' END AS style_id, CASE WHEN kind = 'title' THEN 22.0 ELSE 12.0 END::DOUBLE AS size, count(*) AS n FROM elements GROUP BY ALL""", "style_id string, size double, n long")
def render_styles(spark, sf_dir):
    x = T.page_elements(spark, sf_dir).withColumn("node_type", F.when(F.col("block_type") == "title", "heading").otherwise(F.col("block_type"))).withColumn("global_level", F.col("local_level"))
    return render.with_style(x).groupBy(F.col("style.style_id").alias("style_id"), F.col("style.size").alias("size")).agg(F.count("*").alias("n"))


@query(schema="doc_id long, n_bytes long")
def render_files(spark, sf_dir):
    """The web pages' trees as clean DOCX files."""
    return render.render(tree.build_tree(blocks.preprocess(T.page_elements(spark, sf_dir)))).withColumn("n_bytes", F.length("content"))


class _Moody:
    """A provider whose answer depends on the length of the question: none, a fenced finding, no JSON, a failure, JSON of another shape."""

    def chat(self, user_prompt: str, **_) -> str:
        kind = len(user_prompt) % 5
        if kind == 3:
            raise ConnectionError("busy")
        finding = '{"location": "1", "issue_type": "其他", "description": "d", "confidence": 0.5}'
        return ("[]", f"```json\n[{finding}]\n```", "none", "", '[{"location": "1"}]')[kind]


_QUESTION = len(judge.PROMPTS["semantic_check"][1] % ("", ""))


@query(f"""WITH {ELEMENTS}, k AS (SELECT doc_id, pos, (length(text) + {_QUESTION}) % 5 AS kind FROM elements),
n AS (SELECT *, kind < 2 AND sum((kind < 2)::INT) OVER (PARTITION BY doc_id ORDER BY pos) <= {judge.BUDGET} AS good FROM k)
SELECT doc_id, count(*) AS n_questions, count(*) FILTER (good) AS n_answered, count(*) FILTER (good AND kind = 1) AS n_findings, count(*) FILTER (NOT good) AS n_failed FROM n GROUP BY doc_id""",
       "doc_id long, n_questions long, n_answered long, n_findings long, n_failed long")
def semantic_checks(spark, sf_dir):
    """Every element of the web pages put to a provider that fails in several ways, within each page's budget."""
    x = T.page_elements(spark, sf_dir)
    asked = judge.ask(x.select("doc_id", "pos", F.lit("semantic_check").alias("task"), judge.check_prompt(F.col("text"), F.lit(None)).alias("prompt")), _Moody())
    found = judge.answers(asked, "semantic_check").groupBy("doc_id").agg(F.count("*").alias("n_findings"))
    counts = asked.groupBy("doc_id").agg(F.count("*").alias("n_questions"), F.count("answer").alias("n_answered"), F.count("error").alias("n_failed"))
    return counts.join(found, "doc_id", "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))


@query(f"WITH {ELEMENTS}, {KEPT} SELECT doc_id, 'mock-html' AS model_versions, count(*) + 1 AS n_nodes, 0::BIGINT AS review_queue_count, 0.0::DOUBLE AS review_ratio FROM kept GROUP BY doc_id", "doc_id long, model_versions string, n_nodes long, review_queue_count long, review_ratio double")
def reconstruct(spark, sf_dir):
    """The whole plan over the web pages: headers of the trees, with the pages' own text as spans."""
    x = T.page_elements(spark, sf_dir)
    spans = x.select("doc_id", "pos", F.concat(F.lit("s"), F.col("pos").cast("string")).alias("object_id"), "page_id", "bbox", "text", F.lit("text_span").alias("kind"), F.lit(None).cast("int").alias("row_count"), F.lit(None).cast("int").alias("col_count"), F.lit(None).cast("array<array<string>>").alias("cell_matrix"))
    return pipeline.run(x.drop("tag"), spans).headers
