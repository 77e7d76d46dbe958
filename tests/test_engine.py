"""Golden cases of the engine's operators."""

import json

import pytest
from pyspark.sql import functions as F

from veilgrid.functions import patterns
from veilgrid.functions import text as tx
from veilgrid.operators import annotate, bio, encode, mapping, match, rebuild, rules, vote
from veilgrid.operators.align import align
from veilgrid.sources import conllu, markup

GOLD = [
    ("... numitul Georgică Blatistul, C.N.P. 1891208175432, domiciliat în ...", [(39, 52, "CNP")]),
    ("... numita Petrica Șmenus, CNP:2901101123456", [(31, 44, "CNP")]),
    ("Firma cu numele S.C. Mișto & Tare Co. S.A., cu CUI RO4134567, înregistrată la ...", [(21, 37, "ORG"), (51, 60, "CUI")]),
    ("... numitul Baiby Alba Neagră, tel. 0745677612, s-a aflat ...", [(36, 46, "PHONE")]),
    ("Maria Giorcovan, născută Pristanda Chelaru, la data de 12/11/1994, s-a aflat ...", [(25, 42, "DATE"), (55, 65, "DATE")]),
    ("Maria, născută Țepeș Ștefănescu, la data de 12/11/1994", [(15, 31, "DATE"), (44, 54, "DATE")]),
    ("Mașina cu numărul de înmatriculare BH01ABC a acroșat ...", [(35, 42, "AUTO")]),
    ("Dosar nr.2209/321/2019", [(9, 13, "CASE")]),
    ("Dosar nr. 2219/P/2021", [(10, 14, "CASE")]),
    ("... numitul Babaruncă Nicșor, email: nicsiolaie@theshit.com, s-a aflat ...", [(37, 59, "EMAIL")]),
    ("... numitul Babaruncă Nicșor, legitimat cu C.I. seria AB, nr. 123456, s-a aflat ...", [(54, 56, "ID"), (62, 68, "ID")]),
    ("Proces verbal seria XYZ numărul 123456789, din data de ...", [(20, 23, "ID"), (32, 41, "ID")]),
    ("ECLI:RO:TBNMT:2023:017.000012", [(23, 29, "ECLI")]),
    ("Sentința Civilă NR. 236786, din ...", [(20, 26, "DECISION")]),
    ("ÎNCHEIEREA PENALĂ NR.123456, din ...", [(21, 27, "DECISION")]),
    ("Red. Z.G.-C./Data - 30.06.2023\nTehnored. L.-C.I.\n", [(5, 12, "INITIALS"), (41, 48, "INITIALS")]),
    ("Maria Ioanidi, domiciliată în com. Bucșa, jud. Bihor, sat Verești, str. Alunului nr. 45, s-a aflat ...", [(35, 40, "LOC"), (47, 52, "LOC"), (58, 65, "LOC"), (72, 80, "LOC"), (85, 87, "LOC")]),
    ("Maria Ioanidi, cu domiciliul în jud. Vaslui, oraș Vaslui str. Alunului Beat, nr. 45, bl. B1, sc. 2, apt. 25, s-a aflat ...", [(37, 43, "LOC"), (50, 56, "LOC"), (62, 75, "LOC"), (81, 83, "LOC"), (89, 91, "LOC"), (97, 98, "LOC"), (105, 107, "LOC")]),
    ("Societatea SC Bubu S.R.L, cont bancar RO49AAAA1B31007593840000, cu sediul în ...", [(38, 62, "IBAN")]),
    ("Societatea SC Bubu S.R.L, cont bancar RO 49 AAAA 1B31 0075 9384 0000, cu sediul în ...", [(38, 68, "IBAN")]),
]


def test_pattern_goldens(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(GOLD)] + [(99, "cu avantaje tehnice și economice mari")], "k int, text string")
    got = {r.k: {(x.s, x.e, x.label) for x in r.spans} for r in df.select("k", annotate.pattern_spans(F.col("text"), patterns.ORDER).alias("spans")).collect()}
    for k, (text, want) in enumerate(GOLD):
        assert set(want) <= got[k], (text, got[k])
    assert got[99] == set()


def test_known_city(spark):
    df = spark.createDataFrame([("A fost în București, str. Mare nr. 4, ieri",)], "text string")
    found = df.select(annotate.address_spans(F.col("text"), ("BUCUREȘTI",)).alias("s")).first().s
    assert [("A fost în București, str. Mare nr. 4, ieri"[x.s : x.e]) for x in found] == ["București", "Mare", "4"]


def _labels(spark, files):
    rows = [(0, p, k, n) for k, f in enumerate(files) for p, n in enumerate(f)]
    return spark.createDataFrame(rows, "doc int, pos int, source int, ner string")


@pytest.mark.parametrize(
    ("files", "want"),
    [
        ([["B-PER", "O", "B-ORG", "I-ORG", "I-ORG"]], ["B-PER O B-ORG I-ORG I-ORG"] * 4),
        ([["B-PER", "O", "B-ORG", "I-ORG", "I-ORG"], ["O"] * 5, ["B-PER", "O", "O", "B-ORG", "I-ORG"]], ["O O B-ORG O O", "B-PER O B-ORG I-ORG I-ORG", "O O O O O", "B-PER O O B-ORG I-ORG"]),
        ([["B-PER", "O", "B-ORG", "O", "B-ORG"], ["B-PER", "_", "O", "B-ORG", "O"]], ["O O B-ORG O B-ORG", "B-PER O B-ORG I-ORG I-ORG", "B-PER O O O O", "B-PER O B-ORG I-ORG I-ORG"]),
        ([["B-PER", "O", "B-ORG", "I-ORG", "O"], ["B-PER", "O", "O", "B-ORG", "O"]], ["O O B-ORG O O", "B-PER O B-ORG I-ORG O", "B-PER O O B-ORG O", "B-PER O B-ORG I-ORG O"]),
        ([["B-ORG", "I-ORG", "O"], ["B-ORG", "O", "O"]], ["O B-ORG O", "B-ORG I-ORG O", "B-ORG O O", "B-ORG I-ORG O"]),
    ],
)
def test_votes(spark, files, want):
    labels = _labels(spark, files)
    for algorithm, line in zip(vote.ALGORITHMS, want, strict=True):
        got = " ".join(r.ner for r in vote.vote(labels, ["doc"], algorithm).orderBy("pos").collect())
        assert got == line, algorithm
    with pytest.raises(ValueError):
        vote.vote(labels, ["doc"], "OTHER")


RULES = {"max_sequence_length": 20, "rules": [
    {"name": "mail", "conditions": [{"form": r"(.+)@(\S+)", "ann": "EMAIL"}]},
    {"name": "after", "conditions": [{"ner": "PER", "formFirstLetter": 1, "max": 1}, {"ner": "PER", "formFirstLetter": 2, "ann": "O"}, {"ner": "O", "max": 1}]},
    {"name": "before", "conditions": [{"ner": "O", "max": 1}, {"ner": "PER", "formFirstLetter": 2, "ann": "O"}]},
    {"name": "office", "conditions": [{"form": "biroul", "ann": "ORG"}, {"form": "executorului", "ann": "ORG"}, {"form": "judecătoresc", "ann": "ORG"}, {"ner": "PER|ORG", "ann": "ORG"}]},
]}


def test_rules(spark):
    one = [("Maria", "B-PER"), ("maria@organizatie.com", "_"), ("test", "B-PER"), ("Maria", "I-PER"), ("test", "I-PER"), (".", "_")]
    two = [("BIROUL", "B-ORG"), ("EXECUTORULUI", "I-ORG"), ("JUDECĂTORESC", "I-ORG"), ("TĂNASE", "B-PER"), ("MARIAN", "I-PER"), (".", "O")]
    rows = [("d", s, p, f, f, n) for s, sent in enumerate((one, two)) for p, (f, n) in enumerate(sent)]
    df = spark.createDataFrame(rows, "doc_id string, sent_id int, pos int, form string, lemma string, ner string")
    out = rules.apply_rules(df, RULES, max_passes=1).orderBy("sent_id", "pos").collect()
    assert [r.ner for r in out][:6] == ["B-PER", "O", "O", "B-PER", "O", "O"]
    assert [r.ner for r in out][6:] == ["B-ORG", "I-ORG", "I-ORG", "I-ORG", "I-ORG", "O"]
    later = [r.ner for r in rules.apply_rules(df, RULES).orderBy("sent_id", "pos").collect()]
    assert later[1] == "B-EMAIL"


def test_encoding_goes_on_and_keeps_suffixes(spark):
    rows = [("c", 1, 0, "Mariei", "B-PER"), ("c", 1, 1, "Popescu", "I-PER"), ("c", 1, 2, ",", "O"), ("c", 1, 3, "Iași", "B-LOC"), ("c", 1, 4, "Maria", "B-PER"), ("c", 1, 5, "Popescu", "I-PER")]
    df = spark.createDataFrame(rows, "case_id string, doc_id int, pos int, form string, ner string")
    out, ids = encode.encode(df)
    assert [r.ent_id for r in out.orderBy("pos").collect()] == ["#PER1_ei", "#PER1", "_", "#LOC2", "#PER1", "#PER1"]
    more = spark.createDataFrame([("c", 2, 0, "Iași", "B-LOC"), ("c", 2, 1, ";", "O"), ("c", 2, 2, "Cluj", "B-LOC")], df.schema)
    out, ids = encode.encode(more, ids.select("case_id", "text", "ent_id"))
    assert [r.ent_id for r in out.orderBy("pos").collect()] == ["#LOC2", "_", "#LOC3"]
    assert ids.count() == 3


def test_replacement_tokens(spark):
    cases = [("Maria", "B-PER", "ei", 1, "Mariei"), ("Adina Ionescu", "B-PER", "ei", 2, "Adinei"), ("Adina Ionescu", "B-PER", "ei", 1, "Adinei Ionescu"), ("Adina Ionescu Papadag Bengescu", "I-PER", "", 2, "Papadag"), ("Ana", "I-PER", "", 1, mapping.DELETED)]
    df = spark.createDataFrame(cases, "r string, ner string, sfx string, left int, want string")
    for r in df.withColumn("got", mapping.token_of(F.col("r"), F.col("ner"), F.col("left"), F.col("sfx"), F.lit(True))).collect():
        assert r.got == r.want


def test_pool_wraps_and_prefers_gender(spark):
    ent = spark.createDataFrame([("c", "PER", 1, "Ana Pop"), ("c", "PER", 2, "Ion Pop"), ("c", "PER", 3, "Oana Rus"), ("c", "ORG", 4, "Firma")], "case_id string, type string, seq int, text string")
    pool = spark.createDataFrame([("PER", 1, "Maria Stancu"), ("PER", 2, "Dan Rus")], "type string, place int, candidate string")
    got = {r.seq: (r.replacement, r.wrapped) for r in mapping.from_pool(ent, pool).collect()}
    assert got == {1: ("Maria Stancu", False), 2: ("Dan Rus", False), 3: ("Maria Stancu", True), 4: (None, False)}


def test_rebuild_bytes_and_deletion(spark):
    docs = spark.createDataFrame([(1, "Ștefan vine"), (2, None), (3, "")], "doc_id int, text string")
    edits = spark.createDataFrame([(1, 0, 7, "X"), (1, 2, 3, "lost"), (1, 8, 12, mapping.DELETED)], "doc_id int, s int, e int, replacement string")
    got = {r.doc_id: r.text for r in rebuild.rebuild(docs, edits, ["doc_id"], as_bytes=True).collect()}
    assert got == {1: "X ", 2: None, 3: ""}


def test_dictionary_order_free_with_hyphen(spark):
    words = ["Pop", "-", "Ionei", "merge", "Cluj", "Napoca"]
    df = spark.createDataFrame([(1, 0, k, w) for k, w in enumerate(words)], "doc_id int, sent_id int, pos int, form string")
    entries = spark.createDataFrame([("iona pop", "PER"), ("cluj", "LOC"), ("cluj napoca", "CITY")], "key string, ner string")
    assert [r.ner for r in match.dictionary(df, entries, 2).orderBy("pos").collect()] == ["B-PER", "I-PER", "I-PER", "O", "B-CITY", "I-CITY"]


def test_text_functions(spark):
    row = spark.sql("select 'ş“x”■y' as a, 'A.B.Popescu și/sau' as b, array('(', 'a', ')', ',', 'b', ':', 'c') as c, 'studentei' as d").select(
        tx.normalize_chars(F.col("a")), tx.space_slashes(tx.split_initials(F.col("b"))), tx.detokenize(F.col("c")), tx.stem_of(F.col("d")), tx.suffix_of(F.col("d"))
    ).first()
    assert list(row) == ['ș"x"- y', "A.B. Popescu și / sau", "(a), b: c", "studenta", "ei"]


def test_conllu(spark):
    text = "# global.columns = ID FORM NER\n1\tAna\tB-PER\n2\tvine\tO\n\n1\t.\tO\n\n"
    lines = spark.createDataFrame([("f", k, x) for k, x in enumerate(text.split("\n"))] + [("bad", 0, "1\ta"), ("bad", 1, "3\tb"), ("empty", 0, "")], "doc string, line_no int, line string")
    assert {r.doc: r.valid for r in conllu.validate(lines).collect()} == {"f": True, "bad": False, "empty": True}
    tokens = conllu.from_lines(lines.filter("doc = 'f'"), ("id", "form", "ner"))
    assert [(r.sent_id, r.form, r.ner) for r in tokens.orderBy("pos").collect()] == [(0, "Ana", "B-PER"), (0, "vine", "O"), (1, ".", "O")]
    assert conllu.render(tokens, ["id", "form", "ner"]).first().value == text
    assert conllu.with_declared_columns(lines.filter("doc = 'f'")).orderBy("pos").first().token == {"ID": "1", "FORM": "Ana", "NER": "B-PER"}


def test_markup_words(spark):
    df = spark.createDataFrame([("a&b ș",)], "text string").select(markup.markup_words(markup.wrap_text(F.col("text"))).alias("w"))
    assert [(x.form, x.start, x.end) for x in df.first().w] == [("a", 13, 14), ("&", 14, 19), ("b", 19, 20), ("ș", 21, 23)]


def test_repair_and_align(spark):
    df = spark.createDataFrame([(1, k, n) for k, n in enumerate(["O", "B-PER", "O", "I-PER", "B-ORG", "O", "O", "B-LOC"])], "doc int, pos int, ner string")
    assert [r.ner for r in bio.repair(df, ["doc"]).orderBy("pos").collect()] == ["O", "B-PER", "I-PER", "I-PER", "I-PER", "O", "O", "B-LOC"]
    assert align(["a", "b", "c"], ["a", "x", "b", "c"]) == [(0, 0), (1, 2), (2, 3)]
    assert align([], ["a"]) == []


def test_stream_equals_batch(spark, tmp_path):
    from veilgrid.streaming import tasks

    rows = [(k % 3, k, 0, "PER", f"n{k % 7}") for k in range(40)]
    schema = "case_id int, doc_id int, pos int, type string, text string"
    for part in range(2):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = tasks.stream_case_ids(stream).writeStream.format("memory").queryName("ids").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = encode.allocate(spark.createDataFrame(rows, schema).withColumnRenamed("pos", "first_pos"))
    assert {(r.case_id, r.text) for r in spark.table("ids").collect()} == {(r.case_id, r.text) for r in batch.collect()}


def test_tasks(spark):
    import base64

    from veilgrid.streaming import tasks

    good = base64.b64encode(b"salut").decode()
    df = spark.createDataFrame([("1", "c", "d", good, "txt", 0, 2), ("2", "", "d", good, "txt", 1, 1), ("3", "c", "d", "?", "txt", 1, 1)], tasks.TASK)
    ok, bad = tasks.run_batch(df, [lambda x: x.select("task_id", "text")])
    assert [tuple(r) for r in ok.collect()] == [("1", "salut")]
    assert {r.task_id: r.error for r in bad.collect()} == {"2": "missing caseid", "3": "document is not base64"}
    assert json.loads(json.dumps({"n": 1})) == {"n": 1}


def test_chains_of_overlaps(spark):
    spans = spark.createDataFrame([("d", 0, 5, "A", 0), ("d", 3, 10, "B", 1), ("d", 7, 12, "C", 2), ("e", 1, 2, "A", 0)], "doc string, s int, e int, type string, ord int")
    assert sorted((r.doc, r.s, r.e) for r in rebuild.kept_intervals(spans, ["doc"]).collect()) == [("d", 0, 5), ("d", 7, 12), ("e", 1, 2)]
    assert sorted((r.doc, r.s, r.e, r.type) for r in rebuild.merged_spans(spans, ["doc"]).collect()) == [("d", 0, 12, "B"), ("e", 1, 2, "A")]
    docs = spark.createDataFrame([("d", "0123456789abcdef")], "doc string, text string")
    edits = spans.filter("doc = 'd'").selectExpr("doc", "s", "e", "type as replacement")
    assert rebuild.rebuild(docs, edits, ["doc"]).first().text == "A56Ccdef"


def test_alignment_prefers_the_largest_likeness():
    assert align(["ab", "c"], ["a", "b", "c"]) == [(0, 0), (1, 2)]
    assert align(["x", "y", "z"], ["q", "x", "y", "z", "w"]) == [(0, 1), (1, 2), (2, 3)]
    assert align(["a", "a"], ["a"]) == [(0, 0)] and align(["a"], ["b"]) == []


def test_task_stream_writes_nothing_twice(spark, tmp_path):
    import base64
    import json

    from veilgrid.streaming import tasks

    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    text = base64.b64encode("ă b".encode()).decode()
    rows = [{"task_id": "1", "caseid": "c", "docid": "d", "document": text, "type": "x"}, {"task_id": "2", "caseid": "", "docid": "d", "document": text, "type": "x"}, {"task_id": "1", "caseid": "c", "docid": "d", "document": text, "type": "x"}]
    for k in range(2):  # the second file repeats the first
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        tasks.start(spark, str(folder), out, [], {"availableNow": True}).awaitTermination()
    assert [r.text for r in spark.read.parquet(f"{out}/done").collect()] == ["ă b"]
    assert [r.task_id for r in spark.read.parquet(f"{out}/errors").collect()] == ["2"]
    found = tasks.statuses(spark.createDataFrame([("1",), ("2",), ("3",)], "task_id string"), tasks.states(spark, out))
    assert {r.task_id: r.status for r in found.collect()} == {"1": "DONE", "2": "ERROR", "3": "SCHEDULED"}


def test_files_of_other_encodings(spark, tmp_path):
    (tmp_path / "a.conllup").write_bytes("# k = v\n1\tășț\n\n1\tx".encode("utf-16"))
    rows = conllu.lines(spark, str(tmp_path / "a.conllup"), F.lit("a"), "UTF-16")
    assert [(r.sent_id, r.form) for r in conllu.from_lines(rows, ("id", "form")).orderBy("pos").collect()] == [(0, "ășț"), (1, "x")]
    tokens = spark.createDataFrame([(str(k), 0, 0, 1, "w") for k in range(40)], "doc string, sent_id int, pos int, id int, form string")
    conllu.write_parts(tokens, ["id", "form"], str(tmp_path / "parts"))
    parts = spark.read.option("wholetext", True).text(str(tmp_path / "parts")).groupBy("part").count().collect()
    assert {r.part for r in parts} == {"train", "dev", "test"}


def test_docx_round_trip(spark, tmp_path):
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Ion &amp; Ana</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    assert "Ion &amp; Ana" in markup.read_docx(spark, str(tmp_path / "a.docx")).first()[1]
