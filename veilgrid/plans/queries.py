"""Registered queries of the engine's operators, each with the SQL that gives the same rows.

The tables hold no Romanian legal text, so pattern families run over sentences composed from relational columns; the SQL
knows their offsets by construction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.patterns import spans
from ..operators import annotate, bio, corpus, encode, evaluate, mapping, match, model, rebuild, rules, vote
from ..sources import brat, conllu, gazetteer, markup
from ..streaming import tasks
from . import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- tokens and text -----------------------------------------------------------------------------------------------
_TOKENS = r"""tok AS (SELECT doc_id, form, pos, sum(length(form)) OVER w AS "end", sum(strlen(form)) OVER w AS bend FROM (
  SELECT doc_id, unnest(l) AS form, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|(?s:[^\p{L}\p{N}])') AS l FROM documents))
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"""


@_register(f"""WITH {_TOKENS} SELECT doc_id, count(*) AS n_tokens, CAST(sum("end" - length(form)) AS BIGINT) AS starts, CAST(sum("end") AS BIGINT) AS ends, CAST(max("end") AS BIGINT) AS size FROM tok GROUP BY doc_id""")
def tokenize_offsets(spark, d):
    return markup.tokens(_t(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.max("end").alias("size"))


@_register(f"""WITH {_TOKENS} SELECT doc_id, CAST(sum(bend - strlen(form)) AS BIGINT) AS starts, CAST(sum(bend) AS BIGINT) AS ends, CAST(max(bend) AS BIGINT) AS size FROM tok GROUP BY doc_id""")
def token_byte_offsets(spark, d):
    return markup.tokens(_t(spark, d, "documents")).groupBy("doc_id").agg(F.sum("bstart").alias("starts"), F.sum("bend").alias("ends"), F.max("bend").alias("size"))


_FROM, _TO = "".join(tx.ONE_FOR_ONE), "".join(tx.ONE_FOR_ONE.values())


@_register("SELECT doc_id, md5(regexp_replace(regexp_replace(translate(text, '" + _FROM + "', '" + _TO.replace("'", "''") + r"""'), '[\x{2000}-\x{200e}]', ' ', 'g'), '[\x{2020}-\x{2024}\x{2072}-\x{2073}\x{208f}\x{209d}-\x{209f}\x{25a0}-\x{269f}]', '- ', 'g')) AS digest FROM documents""")
def normalize_chars(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(tx.normalize_chars(F.col("text"))).alias("digest"))


@_register("SELECT p_partkey, 'A.B. ' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS text FROM part")
def split_initials(spark, d):
    return _t(spark, d, "part").select("p_partkey", tx.split_initials(F.expr("concat('A.B.', upper(substr(p_name, 1, 1)), substr(p_name, 2))")).alias("text"))


@_register("SELECT c_custkey, lower(c_mktsegment) || ' / ' || c_mktsegment || ' ' || c_custkey || '/7' AS text FROM customer")
def slash_spacing(spark, d):
    return _t(spark, d, "customer").select("c_custkey", tx.space_slashes(F.expr("concat(lower(c_mktsegment), '/', c_mktsegment, ' ', c_custkey, '/7')")).alias("text"))


@_register(r"""SELECT page_id, CAST(len(p) AS BIGINT) AS n, CAST(coalesce(list_sum(list_transform(p, lambda x: length(x))), 0) AS BIGINT) AS chars FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS p FROM pages)""")
def html_paragraphs(spark, d):
    p = markup.html_paragraphs(F.col("html"))
    return _t(spark, d, "pages").select("page_id", F.size(p).cast("long").alias("n"), F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@_register(r"""SELECT doc_id, md5('<d>' || array_to_string(list_transform(string_split(text, chr(10)), lambda t: '<w:p><w:t>' || replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</w:t></w:p>'), '') || '</d>') AS digest, text AS back FROM documents""")
def text_markup(spark, d):
    wrapped = markup.wrap_text(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.md5(wrapped).alias("digest"), tx.strip_markup(wrapped).alias("back"))


@_register("SELECT c_custkey, c_mktsegment || ' (' || c_name || '), [x]; y.' AS text FROM customer")
def detokenize(spark, d):
    forms = F.expr("array(c_mktsegment, '(', c_name, ')', ',', '[', 'x', ']', ';', 'y', '.')")
    return _t(spark, d, "customer").select("c_custkey", tx.detokenize(forms).alias("text"))


@_register("""SELECT l_orderkey AS doc, bool_and(l_linenumber = n) AS valid FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) GROUP BY l_orderkey""")
def conllu_validate(spark, d):
    rows = _t(spark, d, "lineitem").selectExpr("l_orderkey as doc", "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as line_no", "concat_ws('\t', l_linenumber, l_partkey, 'x') as line")
    return conllu.validate(rows)


_LINES = """SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, 'p' || l_partkey AS form, l_returnflag AS flag FROM lineitem"""


@_register(f"""SELECT doc, '# global.columns = ID FORM NER' || chr(10) || string_agg(pos || chr(9) || form || chr(9) || CASE WHEN flag = 'N' THEN '_' ELSE 'B-' || flag END, chr(10) ORDER BY pos) || chr(10) || chr(10) AS value FROM ({_LINES}) GROUP BY doc""")
def conllu_render(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    rows = spark.sql(_LINES).selectExpr("doc", "0 as sent_id", "pos", "pos as id", "form", "case when flag <> 'N' then concat('B-', flag) end as label")
    return conllu.render(rows, ["id", "form", "label"], {"label": "NER"})


# ---- pattern families: text expression, family, and the spans that it must give ------------------------------------------
def _family(name: str, table: str, key: str, text: str, family: str, want: list[tuple[str, str]]) -> None:
    """want: (text before the capture, capture), each a SQL expression both engines know."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = _t(spark, d, table).selectExpr(f"{key} as id", f"{text} as text")
        return rows.select("id", F.explode(spans(F.col("text"), family)).alias("x")).select("id", "x.s", "x.e", "x.label")

    label = spans_label(family)
    QUERIES[name] = query
    ORACLES[name] = " UNION ALL ".join(f"SELECT {key} AS id, CAST(length({before}) AS INTEGER) AS s, CAST(length({before}) + length({own}) AS INTEGER) AS e, '{label}' AS label FROM {table}" for before, own in want)


def spans_label(family: str) -> str:
    from ..functions.patterns import FAMILIES

    return FAMILIES[family][0]


_O, _C = "o_orderkey", "c_custkey"
_YEAR = "year(o_orderdate)"
_pad = lambda c, n: f"lpad(cast({c} as varchar(30)), {n}, '0')"
_family("cnp", "orders", _O, f"concat('numitul, C.N.P. 1', {_pad('o_orderkey', 12)}, ', domiciliat')", "CNP", [("'numitul, C.N.P. '", f"concat('1', {_pad('o_orderkey', 12)})")])
_family("company", "customer", _C, "concat('Firma S.C. ', upper(c_mktsegment), ' ', c_custkey, ' S.R.L. din')", "FIRMA", [("'Firma S.C. '", "concat(upper(c_mktsegment), ' ', c_custkey)")])
_family("phone", "customer", _C, f"concat('numitul, tel. 07', {_pad('c_custkey', 8)}, ', s-a')", "TELEFON", [("'numitul, tel. '", f"concat('07', {_pad('c_custkey', 8)})")])
_family("birthdate", "orders", _O, f"concat('Maria, născută Popa Ion, la data de 12/11/', {_YEAR}, ', s-a')", "DATA_NASTERII", [("'Maria, născută '", "'Popa Ion'"), ("'Maria, născută Popa Ion, la data de '", f"concat('12/11/', {_YEAR})")])
_family("editor_before", "orders", _O, "concat('Red. Z.G.-C./Data ', o_orderkey)", "TEHNOREDACTOR", [("'Red. '", "'Z.G.-C.'")])
_family("editor_after", "orders", _O, "concat(o_orderkey, ': Popescu-Ion Red. 5')", "TEHNOREDACTOR2", [("concat(o_orderkey, ': ')", "'Popescu-Ion'")])
_family("editor_slash", "orders", _O, "concat(o_orderkey, ' A.B. / Tehn. 5')", "TEHNOREDACTOR3", [("concat(o_orderkey, ' ')", "'A.B.'")])
_family("decision", "orders", _O, "concat('Sentința Civilă NR. ', o_orderkey, ', din')", "HOTARARE", [("'Sentința '", "'Civilă '"), ("'Sentința Civilă NR. '", "cast(o_orderkey as varchar(30))")])
_family("ecli", "orders", _O, f"concat('ECLI:RO:TBNMT:', {_YEAR}, ':017.', {_pad('o_custkey', 6)})", "COD_ECLI", [(f"concat('ECLI:RO:TBNMT:', {_YEAR}, ':017.')", _pad("o_custkey", 6))])
_family("case_no", "orders", _O, f"concat('Dosar nr. ', o_orderkey, '/', o_custkey, '/', {_YEAR})", "NUMAR_DOSAR", [("'Dosar nr. '", "cast(o_orderkey as varchar(30))")])
_family("criminal_case", "orders", _O, f"concat('Dosar nr.', o_orderkey, '/P/', {_YEAR})", "NUMAR_DOSAR_PENAL", [("'Dosar nr.'", "cast(o_orderkey as varchar(30))")])
_family("plate", "orders", _O, f"concat('auto BH', {_pad('o_custkey % 100', 2)}, 'ABC a')", "NUMAR_AUTO", [("'auto '", f"concat('BH', {_pad('o_custkey % 100', 2)}, 'ABC')")])
_family("series_no", "orders", _O, "concat('C.I. seria AB, nr. ', o_orderkey, ', s-a')", "SERIE_NUMAR", [("'C.I. seria '", "'AB'"), ("'C.I. seria AB, nr. '", "cast(o_orderkey as varchar(30))")])
_family("cui", "customer", _C, f"concat('cu CUI RO', {_pad('c_custkey', 7)}, ', la')", "CUI", [("'cu CUI '", f"concat('RO', {_pad('c_custkey', 7)})")])
_family("iban", "customer", _C, f"concat('cont bancar RO49AAAA', {_pad('c_custkey', 16)}, ', cu')", "IBAN", [("'cont bancar '", f"concat('RO49AAAA', {_pad('c_custkey', 16)})")])
_EMAIL = r"\b[a-z0-9._-]+\s?@\s?[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,4}\b"
_PIECES = f"""p AS (SELECT doc_id, source, text, regexp_extract_all(text, '{_EMAIL}') AS m, string_split_regex(text, '{_EMAIL}') AS g FROM documents),
x AS (SELECT doc_id, source, i, m[i] AS text, CAST(list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i-1], lambda z: length(z))), 0) AS INTEGER) AS s FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM p))"""


@_register(f"WITH {_PIECES} SELECT doc_id, s, CAST(s + length(text) AS INTEGER) AS e, text FROM x")
def email_spans(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "text", F.explode(spans(F.col("text"), "EMAIL")).alias("x"))
    return rows.select("doc_id", "x.s", "x.e", F.substring("text", F.col("x.s") + 1, F.col("x.e") - F.col("x.s")).alias("text"))


_ADDRESS = "concat('domiciliat în jud. Vaslui, str. Alunului nr. ', o_custkey % 900 + 1, ', s-a')"


@_register(" UNION ALL ".join(f"SELECT o_orderkey AS id, CAST(length({b}) AS INTEGER) AS s, CAST(length({b}) + length({w}) AS INTEGER) AS e FROM orders" for b, w in (("'domiciliat în jud. '", "'Vaslui'"), ("'domiciliat în jud. Vaslui, str. '", "'Alunului'"), ("'domiciliat în jud. Vaslui, str. Alunului nr. '", "cast(o_custkey % 900 + 1 as varchar)"))))
def address_fields(spark, d):
    rows = _t(spark, d, "orders").selectExpr("o_orderkey as id", f"{_ADDRESS} as text")
    return rows.select("id", F.explode(annotate.address_spans(F.col("text"))).alias("x")).select("id", "x.s", "x.e")


@_register("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def city_semi_join(spark, d):
    nation, region = _t(spark, d, "nation"), _t(spark, d, "region")
    cities = nation.join(region, nation.n_regionkey == region.r_regionkey).filter("r_name in ('ASIA', 'EUROPE')").selectExpr("n_name as name")
    phrases = _t(spark, d, "customer").join(nation, F.col("c_nationkey") == nation.n_nationkey).selectExpr("c_custkey", "concat('Orasul ', lower(n_name)) as phrase")
    return annotate.city_mentions(phrases, cities).select("c_custkey")


@_register("SELECT c_custkey, 'ŞAT-ŢAR ' || c_custkey AS name FROM customer UNION ALL SELECT c_custkey, 'ȘAT-ȚAR ' || c_custkey FROM customer")
def city_variants(spark, d):
    return _t(spark, d, "customer").select("c_custkey", F.explode(tx.city_variants(F.expr("concat('şat-țar ', c_custkey)"))).alias("name"))


# ---- BIO -------------------------------------------------------------------------------------------------------------------
_EV = """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS form,
  CASE WHEN event_type IN ('error', 'view') THEN 'O' WHEN event_id % 3 = 0 THEN 'B-' || upper(event_type) ELSE 'I-' || upper(event_type) END AS ner FROM events"""
_EV_TYPED = f"ev AS (SELECT *, CASE WHEN ner <> 'O' THEN substr(ner, 3) END AS type FROM ({_EV})), ev2 AS (SELECT *, lag(type) OVER (PARTITION BY user_id ORDER BY pos) AS before FROM ev)"
_ISLES = f"{_EV_TYPED}, isles AS (SELECT *, sum(CASE WHEN type IS NOT NULL AND (ner LIKE 'B-%' OR before IS DISTINCT FROM type) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ent_no FROM ev2)"


def _events(spark, d):
    _t(spark, d, "events").createOrReplaceTempView("events")
    return spark.sql(_EV)


@_register(f"WITH {_EV_TYPED} SELECT event_id, CASE WHEN type IS NULL THEN 'O' WHEN before IS NOT DISTINCT FROM type THEN 'I-' || type ELSE 'B-' || type END AS ner FROM ev2")
def bio_normalize(spark, d):
    return bio.renormalize(_events(spark, d), ["user_id"]).select("event_id", "ner")


@_register(f"WITH {_ISLES} SELECT user_id, CAST(ent_no AS BIGINT) AS ent_no, min(type) AS type, CAST(count(*) AS INTEGER) AS n_tok, CAST(min(pos) AS BIGINT) AS first_pos, string_agg(form, ' ' ORDER BY pos) AS text FROM isles WHERE type IS NOT NULL GROUP BY user_id, ent_no")
def bio_islands(spark, d):
    rows = _events(spark, d).selectExpr("*", "0 as start", "0 as `end`")
    return bio.entities(rows, ["user_id"]).selectExpr("user_id", "ent_no", "type", "n_tok", "cast(first_pos as bigint) as first_pos", "text")


@_register(f"WITH {_ISLES} SELECT event_id, CAST(CASE WHEN type IS NOT NULL THEN row_number() OVER (PARTITION BY user_id, CASE WHEN type IS NOT NULL THEN ent_no END ORDER BY pos DESC) END AS INTEGER) AS \"left\" FROM isles")
def reverse_counter(spark, d):
    return bio.reverse_counter(_events(spark, d), ["user_id"]).select("event_id", "left")


@_register(f"SELECT event_id, coalesce(lead(ner) OVER (PARTITION BY user_id ORDER BY pos), 'O') AS ner_next FROM ({_EV})")
def next_label(spark, d):
    return bio.next_label(_events(spark, d), ["user_id"]).select("event_id", "ner_next")


@_register(f"""WITH ev AS (SELECT *, pos * 10 AS s, pos * 10 + CASE WHEN ner = 'O' THEN 10 ELSE 8 END AS e FROM ({_EV})),
f AS (SELECT *, coalesce(CASE WHEN lag(e) OVER (PARTITION BY user_id ORDER BY pos) <> s THEN 1 ELSE 0 END, 1) AS fresh FROM ev),
g AS (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY user_id ORDER BY pos) IS NULL THEN 1 ELSE fresh END AS f2 FROM f),
h AS (SELECT *, sum(f2) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS seg FROM g)
SELECT user_id, CAST(seg AS BIGINT) AS seg, string_agg(form, '' ORDER BY pos) AS text, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS stop FROM h GROUP BY user_id, seg""")
def merge_contiguous(spark, d):
    rows = _events(spark, d).selectExpr("*", "pos * 10 as start", "pos * 10 + case when ner = 'O' then 10 else 8 end as `end`")
    return bio.merge_contiguous(rows, ["user_id"]).selectExpr("user_id", "seg", "text", "cast(start as bigint) as start", "cast(`end` as bigint) as stop")


# ---- votes: three annotators derived from lineitem columns -----------------------------------------------------------------
_VOTERS = """SELECT doc, pos, source, ner FROM (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_partkey, l_suppkey, l_quantity FROM lineitem) t
 CROSS JOIN (SELECT 0 AS source UNION ALL SELECT 1 UNION ALL SELECT 2) s, LATERAL (SELECT CASE (l_partkey * (source + 1) + l_suppkey) % 5 WHEN 0 THEN 'B-PER' WHEN 1 THEN 'I-PER' WHEN 2 THEN 'B-ORG' WHEN 3 THEN 'I-ORG' ELSE 'O' END AS ner) n"""
_VOTED = f"v AS (SELECT *, CASE WHEN ner <> 'O' THEN substr(ner, 3) END AS type FROM ({_VOTERS}))"
_BIO = "SELECT doc, pos, CASE WHEN type IS NULL THEN 'O' WHEN lag(type) OVER (PARTITION BY doc ORDER BY pos) IS NOT DISTINCT FROM type THEN 'I-' || type ELSE 'B-' || type END AS ner FROM one"


def _vote(spark, d, algorithm):
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return vote.vote(spark.sql(_VOTERS), ["doc"], algorithm).selectExpr("doc", "cast(pos as bigint) as pos", "ner")


@_register(f"""WITH {_VOTED}, own AS (SELECT doc, pos, max(CASE WHEN source = 0 THEN ner END) AS ner, max(CASE WHEN source = 0 THEN type END) AS type, bool_or(source > 0 AND type = (SELECT max(o.type) FROM v o WHERE false)) AS unused FROM v GROUP BY doc, pos),
k AS (SELECT a.doc, a.pos, a.ner, a.type, a.type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v b WHERE b.doc = a.doc AND b.pos = a.pos AND b.source > 0 AND b.type = a.type) AS kept FROM own a),
w AS (SELECT *, lag(kept) OVER o AS bk, lag(type) OVER o AS bt FROM k WINDOW o AS (PARTITION BY doc ORDER BY pos))
SELECT doc, pos, CASE WHEN NOT kept THEN 'O' WHEN ner LIKE 'B-%' OR NOT coalesce(bk, false) OR bt IS DISTINCT FROM type THEN 'B-' || type ELSE 'I-' || type END AS ner FROM w""")
def vote_diff(spark, d):
    return _vote(spark, d, "DIFF")


@_register(f"WITH {_VOTED}, one AS (SELECT doc, pos, arg_min(type, source) FILTER (type IS NOT NULL) AS type FROM v GROUP BY doc, pos) {_BIO}")
def vote_add(spark, d):
    return _vote(spark, d, "ADD")


@_register(f"WITH {_VOTED}, one AS (SELECT doc, pos, CASE WHEN count(type) = 3 AND count(DISTINCT type) = 1 THEN min(type) END AS type FROM v GROUP BY doc, pos) {_BIO}")
def vote_intersect(spark, d):
    return _vote(spark, d, "INTERSECT")


@_register(f"""WITH {_VOTED}, c AS (SELECT doc, pos, type, count(*) AS n, min(source) AS first FROM v GROUP BY doc, pos, type),
b AS (SELECT doc, pos, type, n FROM c QUALIFY row_number() OVER (PARTITION BY doc, pos ORDER BY n DESC, type IS NULL, first) = 1), one AS (SELECT doc, pos, CASE WHEN n >= round_even(3 / 2.0, 0) THEN type END AS type FROM b) {_BIO}""")
def vote_majority(spark, d):
    return _vote(spark, d, "MAJORITY")


@_register("SELECT l_orderkey AS doc, count(*) AS rows, CAST(3 AS BIGINT) AS sources, true AS aligned FROM lineitem GROUP BY l_orderkey")
def vote_alignment(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return vote.check_aligned(spark.sql(_VOTERS), ["doc"])


# ---- label precedence, dictionaries, uniform, rules -------------------------------------------------------------------------
_TOK = """SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem"""


@_register(f"""WITH tok AS (SELECT doc, pos, pos * 10 AS s, pos * 10 + 8 AS e FROM ({_TOK})),
sp AS (SELECT o_orderkey AS doc, 0 AS ord, 5 AS s, 25 AS e, 'PER' AS label FROM orders UNION ALL SELECT o_orderkey, 1, CAST(o_custkey % 40 AS INTEGER), CAST(o_custkey % 40 + 15 AS INTEGER), 'ORG' FROM orders),
w AS (SELECT tok.doc, tok.pos, max(ord) AS ord FROM tok JOIN sp ON sp.doc = tok.doc AND sp.s < tok.e AND sp.e > tok.s GROUP BY ALL),
x AS (SELECT tok.doc, tok.pos, w.ord FROM tok LEFT JOIN w USING (doc, pos))
SELECT doc, pos, CASE WHEN ord IS NULL THEN 'O' ELSE CASE WHEN lag(ord) OVER (PARTITION BY doc ORDER BY pos) IS NOT DISTINCT FROM ord THEN 'I-' ELSE 'B-' END || CASE ord WHEN 0 THEN 'PER' ELSE 'ORG' END END AS ner FROM x""")
def label_precedence(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    tok = spark.sql(_TOK).selectExpr("doc", "cast(pos as bigint) as pos", "pos * 10 as start", "pos * 10 + 8 as `end`")
    found = _t(spark, d, "orders").selectExpr("o_orderkey as doc", "array(named_struct('s', 5, 'e', 25, 'label', 'PER'), named_struct('s', cast(o_custkey % 40 as int), 'e', cast(o_custkey % 40 + 15 as int), 'label', 'ORG')) as spans")
    return annotate.label_tokens(tok, found, ["doc"]).select("doc", "pos", "ner")


_WORDS = """SELECT doc_id, 0 AS sent_id, 2 * n + k AS pos, upper(substr(split_part(p_name, ' ', k + 1), 1, 1)) || substr(split_part(p_name, ' ', k + 1), 2) AS form FROM (
  SELECT l_orderkey AS doc_id, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem JOIN part ON l_partkey = p_partkey) t
  CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) s"""
_STEM = "CASE WHEN length({0}) < 4 THEN {0} WHEN {0} LIKE '%ei' THEN left({0}, length({0}) - 2) || 'a' WHEN {0} LIKE '%ăi' THEN left({0}, length({0}) - 2) || 'a' WHEN {0} LIKE '%ilor' THEN left({0}, length({0}) - 4) || 'i' WHEN {0} LIKE '%ul' THEN left({0}, length({0}) - 2) WHEN {0} LIKE '%zii' THEN left({0}, length({0}) - 3) || 'da' ELSE {0} END"


@_register(f"""WITH RECURSIVE w AS (SELECT doc_id, pos, lower({_STEM.format('form')}) AS f, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS w_no FROM ({_WORDS})),
g AS (SELECT array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS key, max_by(p_type, p_partkey) AS ner FROM part GROUP BY 1),
c AS (SELECT a.doc_id, a.w_no, g.ner FROM w a JOIN w b ON b.doc_id = a.doc_id AND b.w_no = a.w_no + 1 JOIN g ON g.key = CASE WHEN a.f <= b.f THEN a.f || ' ' || b.f ELSE b.f || ' ' || a.f END),
r AS (SELECT doc_id, min(w_no) AS w_no FROM c GROUP BY doc_id UNION ALL SELECT r.doc_id, (SELECT min(c.w_no) FROM c WHERE c.doc_id = r.doc_id AND c.w_no >= r.w_no + 2) FROM r WHERE r.w_no IS NOT NULL),
t AS (SELECT r.doc_id, r.w_no, c.ner FROM r JOIN c USING (doc_id, w_no)),
s AS (SELECT doc_id, w_no, 'B-' || ner AS ner FROM t UNION ALL SELECT doc_id, w_no + 1, 'I-' || ner FROM t)
SELECT w.doc_id, w.pos, coalesce(s.ner, 'O') AS ner FROM w LEFT JOIN s USING (doc_id, w_no)""")
def dictionary_match(spark, d):
    for t in ("lineitem", "part"):
        _t(spark, d, t).createOrReplaceTempView(t)
    entries = gazetteer.gazetteer(_t(spark, d, "part").selectExpr("p_type as ner", "p_name as name", "p_partkey as at"))
    words = spark.sql(_WORDS).selectExpr("doc_id", "sent_id", "cast(pos as bigint) as pos", "form")
    return match.dictionary(words, entries, 2).select("doc_id", "pos", "ner")


@_register("SELECT array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS key, max_by(p_type, p_partkey) AS ner, CAST(2 AS INTEGER) AS n_words FROM part GROUP BY 1")
def gazetteer_scan(spark, d):
    return gazetteer.gazetteer(_t(spark, d, "part").selectExpr("p_type as ner", "p_name as name", "p_partkey as at"))


@_register("""WITH a AS (SELECT 'PER' AS type, c_mktsegment || chr(65 + CAST(c_nationkey AS INTEGER)) AS name, c_custkey AS seen FROM customer UNION ALL SELECT 'ORG', p_name, p_partkey FROM part UNION ALL SELECT 'ORG', upper(p_name), -p_partkey - 1 FROM part UNION ALL SELECT 'PER', c_name, c_custkey FROM customer),
f AS (SELECT lower(p_name) AS w, count(*) AS n FROM part GROUP BY 1)
SELECT type, arg_min(name, seen) AS name FROM a WHERE NOT regexp_matches(name, '[0-9,.;:''+=|\\\\]') AND strlen(name) >= 3 AND lower(name) NOT IN (SELECT w FROM f WHERE n >= 60) GROUP BY type, lower(name)""")
def gazetteer_build(spark, d):
    c, p = _t(spark, d, "customer"), _t(spark, d, "part")
    sources = [c.selectExpr("'PER' as type", "concat(c_mktsegment, char(65 + c_nationkey)) as name", "c_custkey as at"), p.selectExpr("'ORG' as type", "p_name as name", "p_partkey as at"), p.selectExpr("'ORG' as type", "upper(p_name) as name", "-p_partkey - 1 as at"), c.selectExpr("'PER' as type", "c_name as name", "c_custkey as at")]
    frequencies = p.groupBy(F.lower("p_name").alias("word")).agg(F.count("*").alias("n"))
    return match.build_gazetteer(sources, frequencies, 60)


@_register("SELECT coalesce(p_type, 'TOTAL') AS type, count(*) AS n FROM part GROUP BY ROLLUP (p_type)")
def dictionary_counts(spark, d):
    return match.dictionary_counts(_t(spark, d, "part").selectExpr("p_type as type"))


@_register(f"""WITH ev AS (SELECT user_id, event_id, pos, form, CASE WHEN event_id % 4 = 0 THEN 'B-PER' WHEN event_id % 4 = 1 THEN 'B-ORG' WHEN event_id % 4 = 2 THEN 'B-LOC' ELSE 'O' END AS ner FROM ({_EV})),
c AS (SELECT user_id, form, substr(ner, 3) AS type, count(*) AS n FROM ev WHERE ner <> 'O' GROUP BY ALL), b AS (SELECT user_id, form, type FROM c QUALIFY row_number() OVER (PARTITION BY user_id, form ORDER BY n DESC, type) = 1),
one AS (SELECT user_id AS doc, pos, event_id, type FROM ev LEFT JOIN b USING (user_id, form))
SELECT event_id, CASE WHEN type IS NULL THEN 'O' WHEN lag(type) OVER (PARTITION BY doc ORDER BY pos) IS NOT DISTINCT FROM type THEN 'I-' || type ELSE 'B-' || type END AS ner FROM one""")
def uniform_mode(spark, d):
    rows = _events(spark, d).selectExpr("user_id as doc_id", "0 as sent_id", "event_id", "pos", "form", "case event_id % 4 when 0 then 'B-PER' when 1 then 'B-ORG' when 2 then 'B-LOC' else 'O' end as ner")
    return match.uniform(rows).select("event_id", "ner")


@_register(f"""WITH one AS (SELECT user_id AS doc, event_id, pos, CASE WHEN regexp_matches(form, '(?i)^SIGN|click') AND coalesce(type, 'O') NOT IN ('ORG') THEN 'ACT' ELSE type END AS type FROM (SELECT *, CASE WHEN ner <> 'O' THEN substr(ner, 3) END AS type FROM ({_EV})))
SELECT event_id, CASE WHEN type IS NULL THEN 'O' WHEN lag(type) OVER (PARTITION BY doc ORDER BY pos) IS NOT DISTINCT FROM type THEN 'I-' || type ELSE 'B-' || type END AS ner FROM one""")
def rule_single(spark, d):
    rows = _events(spark, d).withColumn("lemma", F.col("form"))
    return rules.single(rows, {"conditions": [{"form": "^SIGN|click", "formFirstLetter": 2, "ann": "ACT"}]}, ["user_id"]).select("event_id", "ner")


_RULES = {"max_sequence_length": 4, "rules": [{"name": "two", "conditions": [{"form": "^purchase$", "ann": "BUY"}, {"form": "^click$", "max": 1, "ann": "BUY"}]}]}


@_register(f"""WITH ev AS (SELECT *, CASE WHEN ner <> 'O' THEN substr(ner, 3) END AS type, form = 'purchase' AS p FROM ({_EV})),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) - row_number() OVER (PARTITION BY user_id, p ORDER BY pos) AS g FROM ev),
-- a run of purchases matches as far as the window of 4 lets its click in: the last three before a click, or all of a shorter run
q AS (SELECT *, lag(form) OVER o AS b1 FROM r WINDOW o AS (PARTITION BY user_id ORDER BY pos)), n AS (SELECT *, CASE WHEN p THEN row_number() OVER (PARTITION BY user_id, p, g ORDER BY pos DESC) END AS fromend, CASE WHEN p THEN max(pos) OVER (PARTITION BY user_id, p, g) END AS lastp FROM q),
f AS (SELECT n.*, nx.form AS nextform FROM n LEFT JOIN ({_EV}) nx ON nx.user_id = n.user_id AND nx.pos = n.lastp + 1),
one AS (SELECT user_id AS doc, event_id, pos, CASE WHEN (p AND nextform = 'click' AND fromend <= 3) OR (form = 'click' AND b1 = 'purchase') THEN 'BUY' ELSE type END AS type FROM f)
SELECT event_id, CASE WHEN type IS NULL THEN 'O' WHEN lag(type) OVER (PARTITION BY doc ORDER BY pos) IS NOT DISTINCT FROM type THEN 'I-' || type ELSE 'B-' || type END AS ner FROM one""")
def rule_sequence(spark, d):
    rows = _events(spark, d).selectExpr("user_id as doc_id", "0 as sent_id", "event_id", "pos", "form", "form as lemma", "ner")
    return rules.apply_rules(rows, _RULES, max_passes=1).select("event_id", "ner")


_SFX = "concat(p_type, CASE p_size % 6 WHEN 0 THEN 'ei' WHEN 1 THEN 'ăi' WHEN 2 THEN 'ilor' WHEN 3 THEN 'ul' WHEN 4 THEN 'zii' ELSE '' END)"


@_register(f"SELECT p_partkey, {_STEM.format(_SFX)} AS stem, CASE p_size % 6 WHEN 0 THEN 'ei' WHEN 1 THEN 'ăi' WHEN 2 THEN 'ilor' WHEN 3 THEN 'ul' WHEN 4 THEN 'zii' ELSE '' END AS sfx FROM part")
def suffix_strip(spark, d):
    token = F.expr(_SFX)
    return _t(spark, d, "part").select("p_partkey", tx.stem_of(token).alias("stem"), tx.suffix_of(token).alias("sfx"))


@_register("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Mari' || p_partkey || ' ' || p_name ELSE 'Mariei ' || p_name END AS text FROM part".replace("'Mari' || p_partkey ||", "'Maria' || p_partkey || 'ei' ||"))
def suffix_apply(spark, d):
    name = F.expr("concat(case when p_size % 2 = 0 then concat('Maria', p_partkey) else 'Maria' end, ' ', p_name)")
    return _t(spark, d, "part").select("p_partkey", tx.apply_suffix(name, F.lit("ei")).alias("text"))


# ---- encoding, mapping, rebuilding ------------------------------------------------------------------------------------------
_ENT = "SELECT c_nationkey AS case_id, o_custkey AS doc_id, o_orderkey AS first_pos, upper(substr(o_orderpriority, 3, 3)) AS type, o_orderpriority || ' ' || c_mktsegment AS text FROM orders JOIN customer ON o_custkey = c_custkey"
_IDS = f"f AS (SELECT case_id, text, arg_min(type, (doc_id, first_pos)) AS type, min((doc_id, first_pos)) AS born FROM ({_ENT}) GROUP BY ALL), ids AS (SELECT case_id, text, type, CAST(row_number() OVER (PARTITION BY case_id ORDER BY born) AS INTEGER) AS seq FROM f)"


def _entities(spark, d):
    for t in ("orders", "customer"):
        _t(spark, d, t).createOrReplaceTempView(t)
    return spark.sql(_ENT)


@_register(f"WITH {_IDS} SELECT case_id, text, '#' || type || seq AS ent_id, seq FROM ids")
def encode_ids(spark, d):
    return encode.allocate(_entities(spark, d))


@_register(f"WITH {_IDS} SELECT e.doc_id, e.first_pos, '#' || ids.type || seq AS ent_id FROM ({_ENT}) e JOIN ids USING (case_id, text)")
def encoded_rows(spark, d):
    own = _entities(spark, d)
    return own.join(encode.allocate(own), ["case_id", "text"]).select("doc_id", "first_pos", "ent_id")


@_register(f"WITH {_IDS} SELECT case_id, '#' || type || seq AS ent_id, 'Nr ' || row_number() OVER (PARTITION BY case_id, type ORDER BY seq) AS replacement FROM ids")
def map_counter(spark, d):
    ids = encode.allocate(_entities(spark, d)).withColumns({"type": tx.entity_type(F.col("ent_id")), "extra": F.lit("Nr")})
    return mapping.counter(ids).select("case_id", "ent_id", "replacement")


@_register(f"""WITH {_IDS}, p AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY place) - 1 AS rank, count(*) OVER (PARTITION BY n) AS size FROM (SELECT p_partkey AS place, 'X' || p_name AS candidate, len(string_split(p_name, ' ')) AS n FROM part)),
e AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) - 1 AS draw FROM ids)
SELECT e.case_id, e.seq, p.candidate AS replacement FROM e JOIN p ON p.n = 2 AND p.rank = e.draw % p.size""")
def map_dictionary(spark, d):
    ids = encode.allocate(_entities(spark, d)).withColumns({"type": F.lit("PER"), "text": F.regexp_replace("text", r"^\S+ .*$", "Ion Popescu")})
    pool = _t(spark, d, "part").selectExpr("'PER' as type", "cast(p_partkey as int) as place", "concat('X', p_name) as candidate")
    return mapping.from_pool(ids, pool).select("case_id", "seq", "replacement")


@_register(f"""WITH {_IDS}, w AS (SELECT case_id, seq, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS word_no FROM ids), q AS (SELECT case_id, seq, word_no, unnest(string_split(word, '-')) AS part, generate_subscripts(string_split(word, '-'), 1) AS part_no FROM w),
r AS (SELECT case_id, part, row_number() OVER (PARTITION BY case_id ORDER BY min((seq, word_no, part_no))) - 1 AS r FROM q GROUP BY case_id, part),
l AS (SELECT q.case_id, q.seq, q.word_no, string_agg(repeat(chr(CAST(65 + r % 26 AS INTEGER)), CAST(r // 26 + 1 AS INTEGER)), '-' ORDER BY part_no) AS s FROM q JOIN r USING (case_id, part) GROUP BY ALL)
SELECT case_id, seq, string_agg(s, ' ' ORDER BY word_no) AS replacement FROM l GROUP BY ALL""")
def map_initials(spark, d):
    return mapping.initials(encode.allocate(_entities(spark, d))).select("case_id", "seq", "replacement")


@_register("""SELECT o_custkey AS case_id, '#X' || o_orderkey AS ent_id, CASE WHEN o_orderkey % 3 = 0 THEN 'old new' WHEN o_orderkey % 3 = 1 THEN 'old' ELSE 'new' END AS replacement FROM orders""")
def case_map_upsert(spark, d):
    o = _t(spark, d, "orders").selectExpr("o_custkey as case_id", "concat('#X', o_orderkey) as ent_id", "o_orderkey % 3 as k")
    return gazetteer.upsert_case_map(o.filter("k < 2").selectExpr("case_id", "ent_id", "'old' as replacement"), o.filter("k <> 1").selectExpr("case_id", "ent_id", "'new' as replacement"))


@_register("SELECT p_type AS type, lower(split_part(v, ':', 1)) AS strategy, regexp_replace(v, '^[^:]*:?', '') AS extra FROM (SELECT p_type, max_by('Counter:' || p_name || ':' || p_size, p_partkey) AS v FROM part GROUP BY p_type)")
def strategy_scan(spark, d):
    return gazetteer.strategies(_t(spark, d, "part").selectExpr("p_type as type", "concat('Counter:', p_name, ':', p_size) as value", "p_partkey as at"))


@_register("""SELECT c_custkey AS doc_id, left(c_name, 3) || '<1>' || substr(c_name, 6, 4) || '<2>' || substr(c_name, 13) || ' ă' AS text FROM customer""")
def rebuild_text(spark, d):
    docs = _t(spark, d, "customer").selectExpr("c_custkey as doc_id", "concat(c_name, ' ă') as text")
    edits = docs.selectExpr("doc_id", "explode(array(named_struct('s', 3, 'e', 5, 'replacement', '<1>'), named_struct('s', 9, 'e', 12, 'replacement', '<2>'), named_struct('s', 10, 'e', 11, 'replacement', 'lost'))) as x").select("doc_id", "x.*")
    return rebuild.rebuild(docs, edits, ["doc_id"], as_bytes=True)


@_register("SELECT c_custkey, CAST(length(c_name) + 4 AS INTEGER) AS place FROM customer")
def char_position(spark, d):
    raw = F.expr("cast(concat('<d><w:p><w:t>', c_name, ' &amp;ăș</w:t></w:p></d>') as binary)")
    at = F.expr("cast(13 + length(c_name) + 1 + 5 + 4 as int)")
    return _t(spark, d, "customer").select("c_custkey", tx.char_position(raw, at).alias("place"))


@_register(f"""WITH {_PIECES}, f AS (SELECT source, text, min((doc_id, s)) AS born FROM x GROUP BY ALL), ids AS (SELECT source, text, '#EMAIL' || row_number() OVER (PARTITION BY source ORDER BY born) AS id FROM f),
r AS (SELECT x.doc_id, x.i, ids.id FROM x JOIN ids USING (source, text)), n AS (SELECT doc_id, count(*) AS n, list(id ORDER BY i) AS l FROM r GROUP BY doc_id)
SELECT p.doc_id, coalesce(n, 0) AS n_entities, CASE WHEN n IS NULL THEN p.text ELSE array_to_string(list_transform(generate_series(1, len(g)), lambda k: g[k] || coalesce(l[k], '')), '') END AS text FROM p LEFT JOIN n USING (doc_id)""")
def anonymize_emails(spark, d):
    docs = _t(spark, d, "documents").selectExpr("doc_id", "source as case_id", "text")
    return pipeline.anonymize(docs, ("EMAIL",))[0]


# ---- standoff, evaluation, corpus --------------------------------------------------------------------------------------------
@_register(f"""WITH {_ISLES}, e AS (SELECT user_id, min(type) AS type, min(pos) * 10 AS s, max(pos) * 10 + 8 AS e, string_agg(form, ' ' ORDER BY pos) AS text FROM isles WHERE type IS NOT NULL GROUP BY user_id, ent_no)
SELECT user_id AS doc, string_agg('T' || n || chr(9) || type || ' ' || s || ' ' || e || chr(9) || text, chr(10) ORDER BY n) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, e, type) AS n FROM e) GROUP BY user_id""")
def brat_export(spark, d):
    rows = _events(spark, d).selectExpr("*", "pos * 10 as start", "pos * 10 + 8 as `end`")
    return brat.render(bio.entities(rows, ["user_id"]).withColumnRenamed("user_id", "doc"))


_SPANS = "SELECT l_orderkey AS doc, CAST(l_suppkey % 2 AS INTEGER) AS line, l_returnflag AS label, CAST(l_partkey % 50 AS INTEGER) AS s, CAST(l_partkey % 50 + 3 + l_linenumber AS INTEGER) AS e FROM lineitem"


@_register(f"WITH a AS ({_SPANS}) SELECT a.doc, a.line, a.label AS label1, a.s AS s1, a.e AS e1, b.label AS label2, b.s AS s2, b.e AS e2 FROM a JOIN a b ON a.doc = b.doc AND a.line = b.line AND a.s < b.e AND b.s < a.e AND a.label < b.label")
def brat_conflicts(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return brat.conflicts(spark.sql(_SPANS))


@_register(f"WITH a AS (SELECT DISTINCT * FROM ({_SPANS})) SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE a.doc = b.doc AND a.line = b.line AND a.s < b.e AND b.s < a.e AND a.label <> b.label)")
def brat_merge(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return brat.merge(spark.sql(_SPANS))


@_register("SELECT doc_id AS doc, CAST(1 AS INTEGER) AS line_no, CAST(2 AS INTEGER) AS s, CAST(7 AS INTEGER) AS e, true AS agrees FROM documents")
def brat_paragraphs(spark, d):
    docs = _t(spark, d, "documents").selectExpr("doc_id as doc", "concat(replace(text, '\n', ' '), '\r\n', 'a Maria b') as text")
    spans_ = docs.selectExpr("doc", "'PER' as label", "length(text) - 7 as s", "length(text) - 2 as e", "'Maria' as text")
    return brat.to_paragraphs(docs, spans_).select("doc", "line_no", "s", "e", "agrees")


_PAIRS = "SELECT CASE l_returnflag WHEN 'N' THEN 'O' ELSE l_returnflag END AS gold, CASE WHEN l_partkey % 5 = 0 THEN 'O' WHEN l_suppkey % 7 = 0 THEN 'A' WHEN l_returnflag = 'N' THEN 'R' ELSE l_returnflag END AS pred FROM lineitem"
_REPORT = f"p AS (SELECT * FROM ({_PAIRS}) WHERE NOT (gold = 'O' AND pred = 'O')), l AS (SELECT gold AS label FROM p UNION SELECT pred FROM p), c AS (SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold = label) AS n_gold, count(*) FILTER (pred = label) AS n_pred FROM p, l GROUP BY label)"
_SCORES = "round(CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END, 6) AS precision, round(CASE WHEN n_gold > 0 THEN tp / n_gold ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / n_pred) * (tp / n_gold) / (tp / n_pred + tp / n_gold) ELSE 0 END, 6) AS f1"


def _pairs(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(_PAIRS)


@_register(f"SELECT gold, count(*) FILTER (pred = 'A') AS A, count(*) FILTER (pred = 'O') AS O, count(*) FILTER (pred = 'R') AS R FROM ({_PAIRS}) GROUP BY gold")
def token_confusion(spark, d):
    return evaluate.confusion(_pairs(spark, d), ["A", "O", "R"])


@_register(f"WITH {_REPORT} SELECT label, tp, n_gold, n_pred, {_SCORES} FROM c")
def precision_recall(spark, d):
    return evaluate.report(_pairs(spark, d))


@_register(f"WITH {_REPORT}, s AS (SELECT label, n_gold, {_SCORES} FROM c WHERE label <> 'O') SELECT 'macro' AS kind, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM s UNION ALL SELECT 'weighted', round(sum(precision * n_gold) / sum(n_gold), 6), round(sum(recall * n_gold) / sum(n_gold), 6), round(sum(f1 * n_gold) / sum(n_gold), 6) FROM s")
def report_averages(spark, d):
    return evaluate.averages(evaluate.report(_pairs(spark, d)))


@_register("""WITH p AS (SELECT quality AS a, 1 - toxic AS b FROM labels), n AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS agree FROM p), c AS (SELECT sum(x * y) AS chance FROM (SELECT a AS label, count(*) AS x FROM p GROUP BY a) JOIN (SELECT b AS label, count(*) AS y FROM p GROUP BY b) USING (label))
SELECT n, round((agree / n - chance / (n * n)) / (1 - chance / (n * n)), 2) AS kappa FROM n, c""")
def kappa(spark, d):
    return evaluate.kappa(_t(spark, d, "labels").selectExpr("quality as a", "1 - toxic as b"))


@_register(f"""WITH g AS (SELECT DISTINCT doc, label, s, e FROM ({_SPANS})), p AS (SELECT doc, label, s + 1 AS s, e + 2 AS e FROM g WHERE line = 0 OR line IS NULL OR true),
b AS (SELECT g.label, sum(least(g.e, p.e) - greatest(g.s, p.s)) AS tp FROM g JOIN p ON g.doc = p.doc AND g.label = p.label AND g.s < p.e AND p.s < g.e GROUP BY g.label),
c AS (SELECT x.label, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(n_gold AS BIGINT) AS n_gold, CAST(n_pred AS BIGINT) AS n_pred FROM (SELECT label, sum(e - s) AS n_gold FROM g GROUP BY label) x JOIN (SELECT label, sum(e - s) AS n_pred FROM p GROUP BY label) y USING (label) LEFT JOIN b USING (label))
SELECT label, tp, n_gold, n_pred, {_SCORES} FROM c""".replace(" WHERE line = 0 OR line IS NULL OR true", ""))
def char_overlap_f1(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    g = spark.sql(_SPANS).select("doc", "label", "s", "e").distinct()
    return evaluate.char_overlap(g, g.selectExpr("doc", "label", "s + 1 as s", "e + 2 as e"), ["doc"])


@_register(f"""WITH g AS (SELECT DISTINCT doc, label, s, e FROM ({_SPANS})), p AS (SELECT doc, CASE WHEN s % 4 = 0 THEN 'A' ELSE label END AS label, s, e FROM g), q AS (SELECT DISTINCT * FROM p),
c AS (SELECT label, count(*) FILTER (k = 'h') AS tp, count(*) FILTER (k = 'g') AS n_gold, count(*) FILTER (k = 'p') AS n_pred FROM (SELECT label, 'g' AS k FROM g UNION ALL SELECT label, 'p' FROM q UNION ALL SELECT g.label, 'h' FROM g JOIN q USING (doc, label, s, e)) GROUP BY label)
SELECT label, tp, n_gold, n_pred, {_SCORES} FROM c""")
def span_f1(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    g = spark.sql(_SPANS).select("doc", "label", "s", "e").distinct()
    return evaluate.span_f1(g, g.selectExpr("doc", "case when s % 4 = 0 then 'A' else label end as label", "s", "e"), ["doc"])


@_register(f"""WITH {_TOKENS} SELECT 'files' AS metric, count(DISTINCT doc_id) AS value FROM tok UNION ALL SELECT 'tokens', count(*) FROM tok UNION ALL SELECT 'forms', count(DISTINCT form) FROM tok UNION ALL SELECT 'lower_forms', count(DISTINCT lower(form)) FROM tok
UNION ALL SELECT 'sentences', CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) FROM documents UNION ALL SELECT 'entities', count(*) FROM labels UNION ALL SELECT 'type:' || quality, count(*) FROM labels GROUP BY quality""")
def corpus_stats(spark, d):
    docs = _t(spark, d, "documents")
    sentences = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return corpus.statistics(markup.tokens(docs), sentences, _t(spark, d, "labels").selectExpr("doc_id", "cast(quality as string) as type"))


@_register(f"WITH e AS (SELECT user_id AS doc_id, substr(ner, 3) AS type FROM ({_EV}) WHERE ner <> 'O'), n AS (SELECT doc_id, type, count(*) AS n FROM e GROUP BY ALL) SELECT doc_id, string_agg(type || ':' || n, ', ' ORDER BY type || ':' || n) AS counts FROM n GROUP BY doc_id")
def entity_counts(spark, d):
    e = _events(spark, d).filter("ner <> 'O'").selectExpr("user_id as doc_id", "substr(ner, 3) as type")
    return corpus.counts_text(e)


@_register("""WITH f AS (SELECT c_mktsegment AS corpus, o_orderstatus = 'F' AS gold, CAST(o_custkey % 10 AS INTEGER) AS entities FROM orders JOIN customer ON o_custkey = c_custkey), a AS (SELECT corpus, count(*) AS total, count(*) FILTER (gold) AS gold, CAST(sum(CASE WHEN gold THEN entities ELSE 0 END) AS BIGINT) AS entities FROM f GROUP BY corpus)
SELECT *, CAST(floor(100 * gold / total) AS INTEGER) AS percent, CASE WHEN floor(100 * gold / total) >= 100 THEN 'green' WHEN floor(100 * gold / total) >= 50 THEN 'yellow' WHEN floor(100 * gold / total) > 0 THEN 'orange' ELSE 'red' END AS band FROM a""")
def dashboard(spark, d):
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return corpus.progress(o.selectExpr("c_mktsegment as corpus", "o_orderstatus = 'F' as gold", "cast(o_custkey % 10 as int) as entities"))


_MENTIONS = "SELECT l_orderkey AS file, l_returnflag AS label, CAST(l_partkey AS INTEGER) AS s, CAST(l_partkey + l_linenumber AS INTEGER) AS e, l_suppkey % 3 AS k FROM lineitem"


@_register(f"""WITH m AS ({_MENTIONS}), u AS (SELECT 1 AS u, * FROM m WHERE k < 2 UNION ALL SELECT 2, * FROM m WHERE k > 0),
c AS (SELECT u, file, label, max(s) AS k, min(s) AS first, list_sort(list(DISTINCT s || '_' || e)) AS m FROM u GROUP BY u, file, label), d AS (SELECT u, file, k, max_by(m, (first, label)) AS m FROM c GROUP BY u, file, k),
f AS (SELECT file, bool_or(u = 1) AS a, bool_or(u = 2) AS b FROM u GROUP BY file), cf AS (SELECT file FROM f WHERE a AND b),
j AS (SELECT x.m AS m1, y.m AS m2 FROM (SELECT * FROM d WHERE u = 1 AND file IN (SELECT file FROM cf)) x FULL JOIN (SELECT * FROM d WHERE u = 2 AND file IN (SELECT file FROM cf)) y ON x.file = y.file AND x.k = y.k),
n AS (SELECT count(*) AS o FROM orders)
SELECT (SELECT count(*) FROM f WHERE a) AS files1, (SELECT count(*) FROM f WHERE b) AS files2, (SELECT count(*) FROM cf) AS files_common, (SELECT o FROM n) AS filesr1, (SELECT o FROM n) AS filesr2, (SELECT o FROM n) AS filesr_common,
 count(m1) AS clusters_1, count(m2) AS clusters_2, count(*) FILTER (m1 IS NOT NULL AND m2 IS NOT NULL) AS clusters_common, count(*) FILTER (m1 = m2) AS clusters_common_i,
 CAST(coalesce(sum(CASE WHEN m1 IS NOT NULL AND m2 IS NOT NULL THEN len(m1) END), 0) AS BIGINT) AS clusters_common_w1, CAST(coalesce(sum(CASE WHEN m1 IS NOT NULL AND m2 IS NOT NULL THEN len(m2) END), 0) AS BIGINT) AS clusters_common_w2,
 CAST(coalesce(sum(CASE WHEN m1 IS NOT NULL AND m2 IS NOT NULL THEN len(list_intersect(m1, m2)) END), 0) AS BIGINT) AS clusters_common_wc FROM j""")
def coref_agreement(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    m, files = spark.sql(_MENTIONS), _t(spark, d, "orders").selectExpr("o_orderkey as file")
    return evaluate.coref_agreement(m.filter("k < 2"), m.filter("k > 0"), files, files)


@_register("""SELECT o_orderkey AS line_no, o_orderpriority AS v0, CASE WHEN o_custkey % 4 = 0 THEN o_orderstatus ELSE o_orderpriority END AS v1, CASE WHEN o_custkey % 5 > 0 THEN o_orderpriority END AS v2 FROM orders WHERE o_custkey % 4 = 0 OR o_custkey % 5 = 0""")
def compare_files(spark, d):
    o = _t(spark, d, "orders")
    return evaluate.compare_lines(o.selectExpr("o_orderkey as line_no", "o_orderpriority as value"), o.selectExpr("o_orderkey as line_no", "case when o_custkey % 4 = 0 then o_orderstatus else o_orderpriority end as value"), o.filter("o_custkey % 5 > 0").selectExpr("o_orderkey as line_no", "o_orderpriority as value"))


@_register("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS l FROM documents), b AS (SELECT doc_id, l, unnest(CASE WHEN len(l) > 64 THEN list_sort(list_distinct(list_append(generate_series(0, len(l) - 64, 48), CAST(ceil((len(l) - 64) / 48.0) AS BIGINT) * 48))) ELSE [0] END) AS begin FROM w)
SELECT doc_id, CAST(begin // 48 AS INTEGER) AS win, CAST(begin AS INTEGER) AS begin, CAST(least(64, len(l) - begin) AS INTEGER) AS n, md5(array_to_string(l[begin + 1:begin + 64], ' ')) AS digest FROM b""")
def sliding_windows(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.split("text", " ").alias("pieces"))
    return model.windows(docs, 64, 48).select("doc_id", "win", F.col("begin").cast("int").alias("begin"), F.size("pieces").alias("n"), F.md5(F.array_join("pieces", " ")).alias("digest"))


@_register("""WITH p AS (SELECT l_orderkey AS doc_id, CAST(l_partkey % 4 AS INTEGER) AS pos, l_returnflag AS label, CAST(l_quantity / 100 AS DOUBLE) AS p FROM lineitem), m AS (SELECT doc_id, pos, label, avg(p) AS p FROM p GROUP BY ALL)
SELECT doc_id, pos, label, round(p, 6) AS p FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY round(p, 12) DESC, label DESC) = 1""")
def label_averaging(spark, d):
    p = _t(spark, d, "lineitem").selectExpr("l_orderkey as doc_id", "cast(l_partkey % 4 as int) as pos", "l_returnflag as label", "l_quantity / 100 as p")
    return model.merge_windows(p).withColumn("p", F.round("p", 6))


@_register("SELECT conv_id, turn, md5(trim(coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ''))) AS digest FROM conversations")
def context_window(spark, d):
    rows = _t(spark, d, "conversations").selectExpr("conv_id as doc_id", "turn as sent_id", "text")
    return annotate.with_left_context(rows).select(F.col("doc_id").alias("conv_id"), F.col("sent_id").alias("turn"), F.md5("context").alias("digest"))


# ---- tasks -------------------------------------------------------------------------------------------------------------------
@_register("SELECT o_orderkey AS task_id, row_number() OVER (ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END DESC, o_orderdate, o_orderkey) AS due FROM orders")
def priority_queue(spark, d):
    tasks_ = _t(spark, d, "orders").selectExpr("o_orderkey as task_id", "case when o_orderpriority like '1%' then 1 else 0 end as priority", "o_orderdate as arrived")
    # the place in one global order: ranges of the order are counted first, then rows within a range
    ranged = corpus.queue(tasks_).withColumn("part", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id())
    return _numbered(ranged).select("task_id", "due")


def _numbered(ranged: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy("k"))
    return ranged.withColumn("inner", inner).join(before, "part").withColumn("due", F.col("before") + F.col("inner"))


@_register("""SELECT o_orderkey AS task_id, CASE WHEN o_custkey % 5 = 0 THEN 'missing caseid' WHEN o_custkey % 7 = 0 THEN 'document is not base64' END AS error FROM orders WHERE o_custkey % 5 = 0 OR o_custkey % 7 = 0""")
def task_dead_letter(spark, d):
    rows = _t(spark, d, "orders").selectExpr("o_orderkey as task_id", "case when o_custkey % 5 = 0 then ' ' else 'c' end as caseid", "'d' as docid", "case when o_custkey % 7 = 0 then '?!' else base64(cast(o_orderpriority as binary)) end as document")
    return tasks.split_valid(rows).filter("error is not null").select("task_id", "error")


@_register(None)
def case_state_stream(spark, d):
    """The identifiers that a stream of mentions gets, batch by batch, until the source is read."""
    source = spark.readStream.schema(_t(spark, d, "orders").schema).parquet(f"{d}/orders.parquet*")
    mentions = source.selectExpr("o_custkey % 25 as case_id", "o_orderkey as doc_id", "0 as pos", "upper(substr(o_orderpriority, 3, 3)) as type", "o_orderpriority as text")
    q = tasks.stream_case_ids(mentions).writeStream.format("memory").queryName("case_state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("case_state")
