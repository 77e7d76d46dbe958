"""Registered queries of sources, encoding, mapping, evaluation and tasks that ``queries`` does not reach, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import annotate, bio, corpus, encode, evaluate, mapping, match, model, rebuild, rules, vote
from ..sources import brat, conllu, gazetteer
from ..streaming import tasks
from . import pipeline
from .queries import _BIO, _ENT, _EV, _EV_TYPED, _IDS, _ISLES, _LINES, _SPANS, _TOK, _VOTED, _VOTERS, ORACLES, _entities, _events, _register, _t

_HASH = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"


# ---- files, as lines --------------------------------------------------------------------------------------------------------
def _file(spark, d):
    """Per order: two comments, up to three tokens, a blank line, the other tokens."""
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    _t(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql(f"""SELECT doc, pos + CASE WHEN pos > 3 THEN 3 ELSE 2 END AS line_no, concat_ws('\t', pos, form, flag) AS line FROM ({_LINES})
      UNION ALL SELECT o_orderkey, 0, '# global.columns = ID FORM FLAG' FROM orders UNION ALL SELECT o_orderkey, 1, concat('# source = o', o_orderkey) FROM orders
      UNION ALL SELECT doc, 6, '' FROM ({_LINES}) WHERE pos = 4""")


@_register(f"SELECT doc, CAST(CASE WHEN pos > 3 THEN 1 ELSE 0 END AS INTEGER) AS sent_id, CAST(pos - 1 AS INTEGER) AS pos, CAST(pos AS VARCHAR) AS id, form, flag FROM ({_LINES})")
def conllu_scan(spark, d):
    return conllu.from_lines(_file(spark, d), ("id", "form", "flag"))


@_register(f"SELECT doc, CAST(CASE WHEN pos > 3 THEN 1 ELSE 0 END AS INTEGER) AS sent_id, CAST(pos - 1 AS INTEGER) AS pos, form, flag FROM ({_LINES})")
def conllup_declared(spark, d):
    return conllu.with_declared_columns(_file(spark, d)).select("doc", "sent_id", "pos", F.col("token")["FORM"].alias("form"), F.col("token")["FLAG"].alias("flag"))


@_register("SELECT o_orderkey AS doc, 'ID FORM FLAG' AS columns, 'o' || o_orderkey AS source FROM orders")
def conllu_metadata(spark, d):
    return conllu.metadata(_file(spark, d)).select("doc", F.col("meta")["global.columns"].alias("columns"), F.col("meta")["source"].alias("source"))


@_register(f"SELECT doc, CAST(CASE WHEN pos > 2 THEN 1 ELSE 0 END AS INTEGER) AS sent_id, CAST(pos - 1 AS INTEGER) AS pos, form, 'B-' || flag AS ner FROM ({_LINES})")
def conll2003_scan(spark, d):
    _file(spark, d)
    rows = spark.sql(f"SELECT doc, pos + CASE WHEN pos > 2 THEN 2 ELSE 1 END AS line_no, concat_ws(' ', form, 'NN', 'O', concat('B-', flag)) AS line FROM ({_LINES}) UNION ALL SELECT o_orderkey, 0, '-DOCSTART- -X- O O' FROM orders UNION ALL SELECT doc, 4, '' FROM ({_LINES}) WHERE pos = 3")
    return conllu.from_lines(rows, ("form", "pos_tag", "chunk", "ner"), " ").select("doc", "sent_id", "pos", "form", "ner")


@_register("SELECT o_orderstatus AS corpus, bool_and(o_orderstatus <> 'P') AS valid FROM orders GROUP BY o_orderstatus HAVING o_orderstatus = 'F' UNION ALL SELECT 'P', count(*) = 0 FROM orders WHERE o_orderstatus = 'P'")
def conllu_validate_all(spark, d):
    o = _t(spark, d, "orders")
    rows = lambda s, line: o.filter(F.col("o_orderstatus") == s).selectExpr("o_orderkey as doc", "0 as line_no", f"'{line}' as line")
    return conllu.validate_all(rows("F", "1\\tx")).selectExpr("'F' as corpus", "valid").unionByName(conllu.validate_all(rows("P", "2\\tx")).selectExpr("'P' as corpus", "valid"))


@_register("SELECT p_brand AS type, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS place, p_name AS candidate FROM part")
def replacements_scan(spark, d):
    return gazetteer.replacements(_t(spark, d, "part").selectExpr("p_brand as type", "concat(' ', p_name, '  ') as candidate", "p_partkey as at"))


@_register("SELECT o_custkey AS case_id, o_orderpriority AS text, '#P' || max(o_orderkey) AS ent_id, CAST(max(o_orderkey) AS VARCHAR) AS replacement FROM orders GROUP BY ALL")
def case_map_scan(spark, d):
    return gazetteer.case_map(_t(spark, d, "orders").selectExpr("o_custkey as case_id", "o_orderpriority as text", "concat('#P', o_orderkey) as ent_id", "cast(o_orderkey as string) as replacement", "o_orderkey as at"))


@_register("SELECT o_orderkey, o_custkey AS case_id, '#X' || o_orderkey % 5 AS ent_id, CASE WHEN o_orderkey % 5 IN (1, 2) AND o_custkey % 2 = 0 THEN 'r' || o_custkey || '-' || o_orderkey % 5 END AS replacement FROM orders")
def case_map_lookup(spark, d):
    rows = _t(spark, d, "orders").selectExpr("o_orderkey", "o_custkey as case_id", "concat('#X', o_orderkey % 5) as ent_id")
    cases = _t(spark, d, "customer").filter("c_custkey % 2 = 0").selectExpr("c_custkey as case_id", "explode(array(1, 2, 3)) as k").selectExpr("case_id", "concat('#X', k) as ent_id", "case when k < 3 then concat('r', case_id, '-', k) end as replacement")
    return gazetteer.lookup(rows, cases)


@_register("SELECT p_size AS case_id, part, min(letter) AS letter FROM (SELECT p_size, split_part(p_name, ' ', 1) AS part, chr(65 + CAST(p_partkey % 26 AS INTEGER)) AS letter FROM part UNION ALL SELECT p_size, split_part(p_name, ' ', 2), 'Z' FROM part) GROUP BY ALL")
def case_map_initials(spark, d):
    return gazetteer.case_initials(_t(spark, d, "part").selectExpr("p_size as case_id", "replace(p_name, ' ', '-') as text", "concat(char(65 + p_partkey % 26), ' Z') as replacement"))


@_register("SELECT p_partkey, CAST(p_size AS INTEGER) AS longest, 'n' || p_partkey AS name, CAST(2 AS INTEGER) AS conditions, p_brand AS form FROM part")
def rules_scan(spark, d):
    text = F.expr("""concat('{"max_sequence_length": ', p_size, ', "rules": [{"name": "n', p_partkey, '", "conditions": [{"form": "', p_brand, '", "ann": "X"}, {"ner": "PER", "max": 3}]}]}')""")
    r = _t(spark, d, "part").select("p_partkey", gazetteer.rules(text).alias("r"))
    one = F.col("r.rules")[0]
    return r.select("p_partkey", F.col("r.max_sequence_length").alias("longest"), one["name"].alias("name"), F.size(one["conditions"]).alias("conditions"), one["conditions"][0]["form"].alias("form"))


@_register("SELECT max(len(string_split(p_name, ' '))) + 1 AS longest FROM part")
def gazetteer_longest(spark, d):
    entries = gazetteer.gazetteer(_t(spark, d, "part").selectExpr("p_type as ner", "concat(p_name, ' ', p_brand) as name", "p_partkey as at"))
    return spark.range(1).select(F.lit(gazetteer.longest_entry(entries)).cast("long").alias("longest"))


# ---- predicates, names, files -----------------------------------------------------------------------------------------------
@_register(f"""WITH one AS (SELECT user_id AS doc, event_id, pos, CASE WHEN shown = upper(shown) AND regexp_matches(coalesce(type, 'O'), '(?i)CLI|PUR') THEN 'CAP' ELSE type END AS type FROM (
  SELECT user_id, event_id, pos, CASE WHEN event_id % 2 = 0 THEN upper(form) ELSE form END AS shown, CASE WHEN ner <> 'O' THEN substr(ner, 3) END AS type FROM ({_EV})))
SELECT event_id, CASE WHEN type IS NULL THEN 'O' WHEN lag(type) OVER (PARTITION BY doc ORDER BY pos) IS NOT DISTINCT FROM type THEN 'I-' || type ELSE 'B-' || type END AS ner FROM one""")
def rule_letters(spark, d):
    rows = _events(spark, d).selectExpr("user_id", "event_id", "pos", "case when event_id % 2 = 0 then upper(form) else form end as form", "form as lemma", "ner")
    return rules.single(rows, {"conditions": [{"formAllLetters": "1", "ner": "cli|pur", "ann": "CAP"}]}, ["user_id"], strict=False).select("event_id", "ner")


@_register("""SELECT c_custkey, replace(name, '+', ' ') AS name FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || '+X' WHEN c_custkey % 3 = 1 THEN 'Ion din ' || c_custkey ELSE 'Ana+' || c_custkey END AS name, c_custkey % 5 AS k, c_custkey % 2 AS p FROM customer)
WHERE k > 0 AND NOT (p = 1 AND (replace(name, '+', ' ') = upper(replace(name, '+', ' ')) OR regexp_matches(lower(name), '\\bdin\\b')))""")
def external_names(spark, d):
    rows = _t(spark, d, "customer").selectExpr("c_custkey", "case c_custkey % 3 when 0 then concat(c_mktsegment, '+X') when 1 then concat('Ion din ', c_custkey) else concat('Ana+', c_custkey) end as name", "case when c_custkey % 5 = 0 then 'l' else 'u' end as encoding", "case when c_custkey % 2 = 1 then 'P' else 'O' end as kind")
    return match.clean_external_names(rows).select("c_custkey", "name")


@_register("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'txt' WHEN 1 THEN CASE WHEN o_custkey % 2 = 0 THEN 'docx' END ELSE 'html' END AS kind, 'c' || o_custkey AS case_id, 'c' || o_custkey || '_' || o_orderkey || '.conllup' AS other FROM orders""")
def file_types(spark, d):
    rows = _t(spark, d, "orders").selectExpr("o_orderkey", "concat('c', o_custkey, '_', o_orderkey, case when o_custkey % 2 = 0 then '.DOCX' else '.pdf' end) as name", "case o_orderkey % 3 when 0 then 'TXT' when 1 then 'any' else 'html' end as kind")
    return rows.select("o_orderkey", tx.file_type(F.col("name"), F.col("kind")).alias("kind"), tx.case_of(F.col("name")).alias("case_id"), tx.change_extension(F.col("name"), "conllup").alias("other"))


@_register("SELECT DISTINCT o_custkey AS file FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AND o_custkey IN (SELECT s_suppkey FROM supplier UNION ALL SELECT 4)")
def gold_files(spark, d):
    c, s = _t(spark, d, "customer").filter("c_custkey % 2 = 0").selectExpr("c_custkey as file"), _t(spark, d, "supplier").selectExpr("s_suppkey as file")
    return evaluate.with_files(_t(spark, d, "orders").selectExpr("o_custkey as file").distinct(), c, s.unionByName(s.sparkSession.range(4, 5).toDF("file")))


@_register("SELECT doc, label, doc AS file, text FROM (SELECT l_orderkey AS doc, l_returnflag AS label, 'p' || l_partkey AS text FROM lineitem)")
def entity_inventory(spark, d):
    return corpus.inventory(_t(spark, d, "lineitem").selectExpr("l_orderkey as doc_id", "l_returnflag as type", "concat('p', l_partkey) as text")).selectExpr("file as doc", "label", "file", "text")


# ---- spans and labels -------------------------------------------------------------------------------------------------------
@_register("SELECT o_orderkey AS doc_id, CAST(1 AS INTEGER) AS sent_id, CAST(0 AS INTEGER) AS s, CAST(length(CAST(o_orderkey AS VARCHAR)) AS INTEGER) AS e, 'CASE' AS label FROM orders UNION ALL SELECT o_orderkey, 2, 0, length('X' || o_custkey), 'ORG' FROM orders")
def context_spans(spark, d):
    texts = F.expr("array('Dosar nr.', concat(o_orderkey, '/5/1999 gata S.C. ABC'), concat('X', o_custkey, ' S.R.L. bun'))")
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(texts).alias("sent_id", "text"))
    found = annotate.spans_in_context(rows, lambda c: annotate.pattern_spans(c, ("FIRMA", "NUMAR_DOSAR")))
    return found.select("doc_id", "sent_id", F.explode("spans").alias("x")).select("doc_id", "sent_id", "x.s", "x.e", "x.label")


_COVER = f"""tok AS (SELECT doc, pos, pos * 10 AS s, pos * 10 + 8 AS e FROM ({_TOK})), sp AS (SELECT o_orderkey AS doc, 0 AS ord, 5 AS s, 25 AS e, 'PER' AS label FROM orders UNION ALL SELECT o_orderkey, 1, o_custkey % 40, o_custkey % 40 + 15, 'ORG' FROM orders)"""


@_register(f"""WITH {_COVER}, h AS (SELECT tok.doc, tok.pos, min(ord) FILTER (sp.s < tok.e AND sp.e > tok.s) AS o, min(ord) FILTER (sp.s <= tok.s AND sp.e >= tok.e) AS c FROM tok JOIN sp ON sp.doc = tok.doc GROUP BY ALL)
SELECT doc, pos, CASE o WHEN 0 THEN 'PER' WHEN 1 THEN 'ORG' ELSE 'O' END AS overlaps, CASE c WHEN 0 THEN 'PER' WHEN 1 THEN 'ORG' ELSE 'O' END AS contains FROM h""")
def span_labels(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    tok = spark.sql(_TOK).selectExpr("doc", "cast(pos as bigint) as pos", "pos * 10 as start", "pos * 10 + 8 as `end`")
    sp = _t(spark, d, "orders").selectExpr("o_orderkey as doc", "explode(array(named_struct('ord', 0, 's', 5L, 'e', 25L, 'label', 'PER'), named_struct('ord', 1, 's', o_custkey % 40, 'e', o_custkey % 40 + 15, 'label', 'ORG'))) as x").select("doc", "x.*")
    return evaluate.token_labels(evaluate.token_labels(tok, sp, ["doc"], "overlaps"), sp, ["doc"], "contains", contained=True).select("doc", "pos", "overlaps", "contains")


_CHAIN = "SELECT o_orderkey AS doc, k, o_custkey % 7 + k * 4 AS s, o_custkey % 7 + k * 4 + 3 + (o_orderkey + k) % 9 AS e FROM orders CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) t"


def _chain(spark, d):
    _t(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql(_CHAIN)


@_register(f"""WITH RECURSIVE c AS ({_CHAIN}), r AS (SELECT doc, k, s, e, e AS last, true AS kept FROM c WHERE k = 0
  UNION ALL SELECT c.doc, c.k, c.s, c.e, CASE WHEN c.s >= r.last THEN c.e ELSE r.last END, c.s >= r.last FROM r JOIN c ON c.doc = r.doc AND c.k = r.k + 1)
SELECT doc, CAST(k AS INTEGER) AS k, s, e FROM r WHERE kept""")
def kept_chain(spark, d):
    return rebuild.kept_intervals(_chain(spark, d), ["doc"]).select("doc", "k", "s", "e")


@_register(f"""WITH c AS (SELECT *, coalesce(s >= max(e) OVER (PARTITION BY doc ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM ({_CHAIN})),
g AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM c)
SELECT doc, min(s) AS s, max(e) AS e, max_by('T' || k, (e - s) * 10 + k) AS type FROM g GROUP BY doc, n""")
def merged_chain(spark, d):
    return rebuild.merged_spans(_chain(spark, d).selectExpr("doc", "s", "e", "concat('T', k) as type", "k as ord"), ["doc"])


@_register("SELECT o_orderkey AS doc_id, CAST(2 AS BIGINT) AS n_entities, 'Firma S.C. #ORG1 S.R.L. cu CUI #CUI2 bun' AS text FROM orders")
def anonymize_families(spark, d):
    """A mail address inside a company's name goes with it; a tax number stands apart."""
    docs = _t(spark, d, "orders").selectExpr("o_orderkey as doc_id", "o_orderkey as case_id", "concat('Firma S.C. ABC a', o_custkey, '@firma.ro S.R.L. cu CUI RO', lpad(o_custkey, 7, '1'), ' bun') as text")
    return pipeline.anonymize(docs, ("FIRMA", "EMAIL", "CUI"))[0]


@_register(f"""WITH t AS (SELECT user_id, event_id, pos, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'T' || event_id % 3 END AS type FROM ({_EV})),
n AS (SELECT *, max(CASE WHEN type IS NOT NULL THEN pos END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, min(CASE WHEN type IS NOT NULL THEN pos END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM t WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
r AS (SELECT *, CASE WHEN type IS NOT NULL OR a - b <= 2 THEN sum(CASE WHEN type IS NOT NULL AND (b IS NULL OR pos - b > 2) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) END AS run FROM n),
v AS (SELECT user_id, run, type, count(*) AS c FROM r WHERE run IS NOT NULL AND type IS NOT NULL GROUP BY ALL),
m AS (SELECT user_id, run, type AS best FROM v QUALIFY row_number() OVER (PARTITION BY user_id, run ORDER BY c DESC, type) = 1)
SELECT event_id, CASE WHEN best IS NULL THEN 'O' WHEN lag(r.run) OVER (PARTITION BY r.user_id ORDER BY pos) IS NOT DISTINCT FROM r.run THEN 'I-' || best ELSE 'B-' || best END AS ner FROM r LEFT JOIN m ON m.user_id = r.user_id AND m.run = r.run""")
def bio_repair(spark, d):
    rows = _events(spark, d).selectExpr("user_id", "event_id", "pos", "case when event_id % 4 = 0 then 'O' else concat('B-T', event_id % 3) end as ner")
    return bio.repair(rows, ["user_id"]).select("event_id", "ner")


@_register(f"WITH one AS (SELECT user_id AS doc, event_id, pos, type FROM (SELECT * FROM (WITH {_EV_TYPED} SELECT * FROM ev))) SELECT event_id, CASE WHEN type IS NULL THEN 'O' WHEN lag(type) OVER (PARTITION BY doc ORDER BY pos) IS NOT DISTINCT FROM type THEN 'I-' || type ELSE 'B-' || type END AS ner FROM one")
def bio_from_flat(spark, d):
    return bio.from_flat(_events(spark, d).withColumn("label", tx.label_type(F.col("ner"))), ["user_id"]).select("event_id", "ner")


@_register(f"WITH {_VOTED}, one AS (SELECT doc, pos, type FROM v WHERE source = 1) {_BIO}")
def vote_single(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return vote.vote(spark.sql(_VOTERS).filter("source = 1"), ["doc"], "ADD").selectExpr("doc", "cast(pos as bigint) as pos", "ner")


@_register(f"SELECT 0 AS place, 'O' AS label UNION ALL SELECT CAST(2 * n - 1 + k AS INTEGER), CASE k WHEN 0 THEN 'B-' ELSE 'I-' END || label FROM (SELECT label, row_number() OVER (ORDER BY label) AS n FROM (SELECT DISTINCT label FROM ({_SPANS}))) CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) t")
def brat_labels(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return brat.label_inventory(spark.sql(_SPANS))


@_register("""WITH m AS (SELECT doc_id, w, CASE WHEN w = 0 THEN coalesce(quality, 0) WHEN w = 1 THEN toxic ELSE (quality + toxic) % 2 END AS label FROM labels CROSS JOIN (SELECT 0 AS w UNION ALL SELECT 1 UNION ALL SELECT 2) t WHERE w < 2 OR doc_id % 2 = 0),
p AS (SELECT a.w AS one, b.w AS two, a.label AS a, b.label AS b FROM m a JOIN m b USING (doc_id) WHERE a.w < b.w), n AS (SELECT one, two, count(*) AS n, count(*) FILTER (a = b) AS agree FROM p GROUP BY ALL),
x AS (SELECT one, two, a AS label, count(*) AS x FROM p GROUP BY ALL), y AS (SELECT one, two, b AS label, count(*) AS y FROM p GROUP BY ALL), c AS (SELECT one, two, sum(x * y) AS chance FROM x JOIN y USING (one, two, label) GROUP BY ALL)
SELECT one, two, n, round(CASE WHEN chance / (n * n) = 1 THEN 1.0 ELSE (agree / n - coalesce(chance, 0) / (n * n)) / (1 - coalesce(chance, 0) / (n * n)) END, 2) AS kappa FROM n LEFT JOIN c USING (one, two)""")
def kappa_pairs(spark, d):
    x = _t(spark, d, "labels").selectExpr("doc_id", "explode(array(named_struct('annotator', 0, 'label', coalesce(quality, 0)), named_struct('annotator', 1, 'label', toxic), named_struct('annotator', 2, 'label', (quality + toxic) % 2))) as x").select("doc_id", "x.*")
    return evaluate.pairwise_kappa(x.filter("annotator < 2 or doc_id % 2 = 0"), ["doc_id"])


# ---- identifiers and replacements ---------------------------------------------------------------------------------------------
@_register(f"""WITH {_ISLES}, e AS (SELECT user_id % 7 AS case_id, user_id AS doc_id, ent_no, min(type) AS type, min(pos) AS first_pos, string_agg(form, ' ' ORDER BY pos) AS text FROM isles WHERE type IS NOT NULL GROUP BY user_id, ent_no),
f AS (SELECT case_id, text, arg_min(type, (doc_id, first_pos)) AS type, min((doc_id, first_pos)) AS born FROM e WHERE text <> 'click' GROUP BY ALL),
ids AS (SELECT case_id, text, '#' || type || (1 + row_number() OVER (PARTITION BY case_id ORDER BY born)) AS ent_id FROM f UNION ALL SELECT DISTINCT user_id % 7, 'click', '#OLD1' FROM events)
SELECT i.event_id, coalesce(ids.ent_id, '_') AS ent_id FROM isles i LEFT JOIN e ON i.type IS NOT NULL AND e.doc_id = i.user_id AND e.ent_no = i.ent_no LEFT JOIN ids ON ids.case_id = e.case_id AND ids.text = e.text""")
def encode_tokens(spark, d):
    rows = _events(spark, d).selectExpr("user_id % 7 as case_id", "user_id as doc_id", "event_id", "pos", "form", "ner")
    known = rows.select("case_id").distinct().selectExpr("case_id", "'click' as text", "'#OLD1' as ent_id")
    return encode.encode(rows, known)[0].select("event_id", "ent_id")


_MARKS = f"repeat({{0}}, CAST(3 + {_HASH.format('ent_id || chr(58) || 0')} % 8 AS INTEGER))"


@_register(f"WITH {_IDS} SELECT case_id, ent_id, {_MARKS.format(chr(39) + 'X' + chr(39))} AS replacement FROM (SELECT case_id, '#' || type || seq AS ent_id FROM ids)")
def map_character(spark, d):
    return encode.allocate(_entities(spark, d)).select("case_id", "ent_id", mapping.character(F.col("ent_id"), F.lit("X")).alias("replacement"))


@_register(f"""WITH {_IDS} SELECT case_id, ent_id, CASE type WHEN 'URG' THEN 'Nr ' || row_number() OVER (PARTITION BY case_id, type ORDER BY seq) WHEN 'HIG' THEN {_MARKS.format("'Y'")} ELSE {_MARKS.format("'X'")} END AS replacement FROM (SELECT *, '#' || type || seq AS ent_id FROM ids)""")
def allocate_strategies(spark, d):
    strategies = spark.createDataFrame([("URG", "counter", "Nr"), ("HIG", "character", "Y")], "type string, strategy string, extra string")
    pool = spark.createDataFrame([], "type string, place int, candidate string")
    return mapping.allocate(encode.allocate(_entities(spark, d)), strategies, pool).select("case_id", "ent_id", "replacement")


@_register(f"""WITH {_ISLES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, ent_no ORDER BY pos DESC) AS l, row_number() OVER (PARTITION BY user_id, ent_no ORDER BY pos) AS f FROM isles WHERE type IS NOT NULL)
SELECT i.event_id, CASE WHEN i.type IS NULL THEN '_' WHEN i.ner LIKE 'B-%' THEN CASE WHEN l = 1 THEN 'Ana' || ent || ' Pop' ELSE 'Ana' || ent END WHEN l = 1 THEN 'Pop' ELSE '!DELETE!' END AS replacement
FROM isles i LEFT JOIN (SELECT event_id, l, ent_no AS ent FROM r) USING (event_id)""")
def replace_rows(spark, d):
    rows = bio.islands(_events(spark, d), ["user_id"]).selectExpr("0 as case_id", "user_id as doc_id", "event_id", "pos", "form", "ner", "case when ent_no is null then '_' else concat('#PER', user_id, 'n', ent_no) end as ent_id", "ent_no")
    mapped = rows.filter("ent_id <> '_'").select("case_id", "ent_id", F.lit("counter").alias("strategy"), F.concat(F.lit("Ana"), F.col("ent_no").cast("string"), F.lit(" Pop")).alias("replacement")).distinct()
    return mapping.replace_rows(rows.drop("ent_no"), mapped).select("event_id", "replacement")


@_register("""WITH f AS (SELECT c_nationkey AS case_id, c_custkey AS seq, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS rank FROM customer), s AS (SELECT *, CASE WHEN case_id % 2 = 0 THEN 24 ELSE 26 END AS size FROM f)
SELECT case_id, seq, repeat(chr(CAST(65 + rank % size + (26 - size) AS INTEGER)), CAST(rank // size + 1 AS INTEGER)) AS replacement FROM s""")
def initials_used(spark, d):
    c = _t(spark, d, "customer")
    rows = c.selectExpr("c_nationkey as case_id", "c_custkey as seq", "replace(c_name, '#', 'n') as text", "'' as extra")
    used = c.filter("c_nationkey % 2 = 0").selectExpr("c_nationkey as case_id", "explode(array('A', 'B')) as letter").distinct()
    return mapping.initials(rows, used).select("case_id", "seq", "replacement")


# ---- around models --------------------------------------------------------------------------------------------------------
@_register(ORACLES["sliding_windows"].replace("48", "44"))
def overlapping_windows(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.split("text", " ").alias("pieces"))
    return model.overlapping(docs, 64).select("doc_id", "win", F.col("begin").cast("int").alias("begin"), F.size("pieces").alias("n"), F.md5(F.array_join("pieces", " ")).alias("digest"))


@_register(f"SELECT user_id FROM ({_EV}) WHERE user_id % 3 = 0 OR event_id % 50 = 1 GROUP BY user_id HAVING bool_or(ner <> 'O')")
def entity_windows(spark, d):
    rows = _events(spark, d).filter("user_id % 3 = 0 or event_id % 50 = 1").groupBy("user_id").agg(F.collect_list("ner").alias("labels"))
    return rows.filter(model.has_entity(F.col("labels"))).select("user_id")


@_register("""SELECT p_partkey AS doc_id, concat_ws(',', p_size, p_size + 1, p_partkey, 1, 1) AS input_ids, '1,1,1,0,0' AS input_mask, '4,-100,5,-100,-100' AS label_ids, '1,0,1,0,0' AS valid FROM part""")
def model_features(spark, d):
    rows = _t(spark, d, "part").selectExpr("p_partkey as doc_id", "array(array(int(p_size), int(p_size + 1)), array(int(p_partkey))) as ids", "array(4, 5) as labels")
    out = model.features(rows, 5)
    return out.select("doc_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("input_ids", "input_mask", "label_ids", "valid")])


@_register("SELECT l_orderkey AS doc_id, CAST(l_partkey % 4 AS INTEGER) AS pos, 'L' || min(l_partkey) % 7 AS label FROM lineitem GROUP BY ALL")
def first_window(spark, d):
    return model.first_window(_t(spark, d, "lineitem").selectExpr("l_orderkey as doc_id", "cast(l_partkey % 4 as int) as pos", "l_partkey as win", "concat('L', l_partkey % 7) as label"))


def _long_words():
    return lambda sentences: [["B-LONG" if len(w) > 5 else "O" for w in s] for s in sentences]


@_register(f"SELECT event_id, CASE WHEN length(form) > 5 THEN 'B-LONG' ELSE 'O' END AS ner FROM ({_EV})")
def model_tags(spark, d):
    rows = _events(spark, d).selectExpr("user_id as doc_id", "0 as sent_id", "cast(pos as int) as pos", "event_id", "form")
    return model.tag(rows, _long_words).select("event_id", "ner")


@_register("""SELECT o_orderkey AS doc_id, CAST(k AS INTEGER) AS sent_id, CAST(CASE k WHEN 0 THEN 0 ELSE length('Dosar ' || o_orderkey || '. ') END AS BIGINT) AS "begin", CASE k WHEN 0 THEN 'Dosar ' || o_orderkey || '. ' ELSE 'Altul, nr. 5 aici!' END AS text FROM orders CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) t""")
def sentence_split(spark, d):
    docs = _t(spark, d, "orders").selectExpr("o_orderkey as doc_id", "concat('Dosar ', o_orderkey, '. Altul, nr. 5 aici!') as text")
    return annotate.sentences_of(docs).select("doc_id", "sent_id", F.col("begin").cast("long").alias("begin"), "text")


# ---- splits, tasks, health ----------------------------------------------------------------------------------------------------
@_register(f"SELECT CAST(doc_id AS VARCHAR) AS doc, CASE WHEN h < 60 THEN 'train' WHEN h < 80 THEN 'dev' ELSE 'test' END AS part FROM (SELECT doc_id, {_HASH.format('doc_id || chr(58) || 7')} % 100 AS h FROM documents)")
def train_split(spark, d):
    return conllu.train_split(_t(spark, d, "documents").selectExpr("cast(doc_id as string) as doc")).select("doc", "part")


@_register(f"""WITH m AS (SELECT doc, label, sum(e - s) AS m FROM ({_SPANS}) GROUP BY ALL), r AS (SELECT *, sum(m) OVER (PARTITION BY label) * 0.1 AS due, sum(m) OVER (PARTITION BY label ORDER BY {_HASH.format('CAST(doc AS VARCHAR)')}, doc) - m AS before FROM m)
SELECT doc, CASE WHEN bool_and(before < due) THEN 'dev' ELSE 'train' END AS part FROM r GROUP BY doc""")
def stratified_split(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return evaluate.stratified_split(spark.sql(_SPANS))


@_register("SELECT o_orderkey AS task_id, CASE WHEN o_custkey % 3 = 0 THEN 'DONE' WHEN o_custkey % 3 = 1 THEN 'RUNNING' ELSE 'SCHEDULED' END AS status, o_custkey % 3 > 0 AS open FROM orders")
def task_states(spark, d):
    o = _t(spark, d, "orders")
    moved = o.filter("o_custkey % 3 < 2").selectExpr("o_orderkey as task_id", "'RUNNING' as state", "0 as at").unionByName(o.filter("o_custkey % 3 = 0").selectExpr("o_orderkey as task_id", "'DONE' as state", "2 as at"))
    all_tasks = o.selectExpr("o_orderkey as task_id")
    left = tasks.open_tasks(all_tasks, moved.filter("state = 'DONE'")).withColumn("open", F.lit(True))
    return tasks.statuses(all_tasks, moved).join(left, "task_id", "left").select("task_id", "status", F.coalesce("open", F.lit(False)).alias("open"))


@_register("SELECT bool_and(s_acctbal > 0) AS ok, arg_min(s_name, s_suppkey) FILTER (s_acctbal <= 0) AS failed FROM supplier")
def health(spark, d):
    return corpus.health(_t(spark, d, "supplier").selectExpr("s_suppkey as place", "s_name as name", "s_acctbal > 0 as ok"))
