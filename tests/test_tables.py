import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from cloakframe.functions.tokens import Keys
from cloakframe.operators import classify, kits
from cloakframe.sources import documents, lines, tables, trees

KEYS = Keys.derive(b"k" * 32, "demo")


def parsed(spark, fmt, text):
    parse, render = lines.PARSERS[fmt]
    df = spark.createDataFrame([(text,)], "v string").select(parse(F.col("v")).alias("r"))
    r = df.select("r", render(F.col("r")).alias("line")).first()
    return (r.r and ([*r.r.header], [(p.key, p.value, p.quoted) for p in r.r.pairs], r.r.prefix)), r.line


def test_cef(spark):
    line = r"CEF:0|Ve\|ndor|P|1|100|na\\me|5|suser=bob smith msg=a\=b c act=x"
    (header, pairs, _), back = parsed(spark, "cef", line)
    assert header == ["0", "Ve|ndor", "P", "1", "100", "na\\me", "5"] and pairs == [("suser", "bob smith", False), ("msg", "a=b c", False), ("act", "x", False)] and back == line
    assert parsed(spark, "cef", "CEF:0|too|short")[0] is None and parsed(spark, "cef", "other")[0] is None


@pytest.mark.parametrize("line", ["LEEF:1.0|V|P|1|c|a=1\tb=two words", "LEEF:2.0|V|P|1|c|^|a=1^b=two words", "LEEF:1.0|V|P|1|c|a=1 b=two"])
def test_leef(spark, line):
    (header, pairs, _), back = parsed(spark, "leef", line)
    assert header == [line[5:8], "V", "P", "1", "c"] and [p[0] for p in pairs] == ["a", "b"] and pairs[1][1].startswith("two") and back == line


def test_leef_hex_delimiter(spark):
    assert parsed(spark, "leef", "LEEF:2.0|V|P|1|c|0x5E|a=1^b=2")[0][1] == [("a", "1", False), ("b", "2", False)]
    assert parsed(spark, "leef", "LEEF:2.0|V|P|1|c|^|a=1^junk")[0] is None


def test_syslog(spark):
    line = '<13>Jan  1 10:00:00 web1 app: user="bob smith" action=allow'
    (_, pairs, prefix), back = parsed(spark, "syslog", line)
    assert pairs == [("user", "bob smith", True), ("action", "allow", False)] and prefix == "<13>Jan  1 10:00:00 web1 app:" and back == line
    assert parsed(spark, "syslog", "user=bob and then text")[0] is None and parsed(spark, "syslog", "no pairs")[0] is None
    host = spark.range(1).select(lines.syslog_host(F.lit(prefix)).alias("a"), lines.syslog_host(F.lit("<1>1 2024-01-01T00:00:00Z h2 app")).alias("b")).first()
    assert (host.a, host.b) == ("web1", "h2")


@pytest.mark.parametrize("want,rows", [("cef", ["CEF:0|a|b|c|d|e|5|x=1"]), ("leef", ["LEEF:1.0|a|b|c|d|x=1"]), ("ndjson", ['{"a":1}', "", '{"a":2}']), ("json", ['{"a":1}']), ("json", ['{"a":1}', "{bad"]), ("syslog", ["h a=1 b=2", "h a=2 b=3"]), (None, ["plain text", "a=1 b=2"]), (None, [])])
def test_format_detection(spark, want, rows):
    assert lines.detect_format(spark.createDataFrame([(r,) for r in rows], "value string")) == want


def test_json_leaves(spark):
    docs = [(1, '{"a":{"b":"x","n":1},"l":[{"c":"y"},{"c":"z"}],"t":true,"u":null}'), (2, '{"a":1,"a":2}'), (3, "[NaN]"), (4, None)]
    df = spark.createDataFrame(docs, "id long, doc string")
    got = sorted((r.id, r.path, r.value) for r in trees.flatten(df, "id", "doc").collect() if r.value is not None)
    assert got == [(1, "a.b", "x"), (1, "a.n", "1"), (1, "l[].c", "y"), (1, "l[].c", "z"), (1, "t", "true")]
    out = {r.id: r.doc for r in trees.mask_json(df.where("id = 1"), "id", "doc", lambda p: ("mask", "k") if p == "l[].c" else ("keep", None), lambda k, v: F.concat(F.lit("M"), v)).collect()}
    assert json.loads(out[1]) == {"a": {"b": "x", "n": 1}, "l": [{"c": "My"}, {"c": "Mz"}], "t": True, "u": None}


def test_json_masks_every_leaf_or_raises(spark):
    deep = json.dumps({"a": "secret"})
    for _ in range(400):
        deep = json.dumps([{"d": json.loads(deep)}])
    wide = json.dumps({f"user{i}": {"mail": f"secret{i}", "n": 1e-8, "on": True, "none": None} for i in range(101_000)})
    df = spark.createDataFrame([(1, deep), (1, wide), (2, None), (3, '"secret"')], "id long, doc string")
    paths = trees.flatten(df, "id", "doc").where("value LIKE 'secret%'").select("path").distinct()
    assert paths.count() == 101_002
    decide = lambda p: ("redact", None) if p.endswith(".n") else ("mask", "k")
    out = [r.doc for r in trees.mask_json(df, "id", "doc", decide, lambda k, v: F.lit("masked")).collect()]
    assert out[2] is None and out[3] == '"masked"' and not [d for d in out if d and "secret" in d] and out[0].count("masked") == 1
    assert json.loads(out[1])["user100999"] == {"mail": "masked", "n": "[ELIDED]", "on": True, "none": None}
    bad = spark.createDataFrame([(1, '{"mail":"secret"'), (2, '{"a":"secret","a":"secret"}'), (3, '{"a":"x"}')], "id long, doc string")
    with pytest.raises(Exception, match="no JSON document"):
        trees.mask_json(bad, "id", "doc", decide, lambda k, v: F.lit("masked")).collect()
    assert [r.doc for r in trees.mask_json(bad, "id", "doc", decide, lambda k, v: F.lit("masked"), invalid="null").collect()] == [None, None, '{"a":"masked"}']


def test_csv(spark, tmp_path):
    assert tables.sniff("a;b;c\n1;2;3\n") == ";" and tables.looks_like_csv("a,b,c\n1,2,3\n4,5,6") and not tables.looks_like_csv("just words\nand words")
    assert tables.collapsed(["one two three four five six seven eight"]) and not tables.collapsed(["a", "b"])
    (tmp_path / "t.csv").write_text('user,note\nbob,"a, b"\n,x\n')
    df = tables.read_csv(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["user", "note"] and sorted((r.user, r.note) for r in df.collect()) == [("", "x"), ("bob", "a, b")]
    tables.write_csv(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_names_and_kits(tmp_path):
    assert classify.candidates("_source.winlog.event_data.TargetUserName[]")[-1] == "targetusername"
    assert classify.detect_kit(["devname", "devid", "logid", "srcip", "policyid"])[0] == "fortinet" and classify.detect_kit(["a", "b"])[0] is None
    for kit in kits.KITS.values():
        assert classify.detect_kit(list(kit.fingerprints))[0] == kit.id
        assert not any(p in (".*", ".+") and a == "keep" for p, a, _ in kit.rules)
    assert classify.safe_name("event_count") and not classify.safe_name("updated_by") and not classify.safe_name("account_manager")
    (tmp_path / "k.json").write_text(json.dumps({"id": "okta", "rules": [{"pattern": "mine", "action": "mask", "kind": "user"}]}))
    assert kits.load(tmp_path)["okta"].rules[0] == ("mine", "mask", "user") and len(kits.load(tmp_path)) == 21
    (tmp_path / "k.json").write_text(json.dumps({"id": "x y", "rules": [{"pattern": "(a+)+", "action": "mask"}]}))
    with pytest.raises(ValueError):
        kits.load(tmp_path)


def test_classification_and_masking(spark):
    rows = [("10.0.0.1", "bob", "x1@example.com", "5", "Text of the message mentions 8.8.8.8 and more words", "zz9", "a")] * 10 + [("bad", "", "", "6", "", "", "")]
    df = spark.createDataFrame(rows, "source_ip string, username string, strange string, severity string, message string, mystery string, old string")
    plan = {d.column: d for d in classify.plan(df, overrides={"old": ("drop", None)})}
    assert (plan["source_ip"].kind, plan["username"].kind, plan["strange"].kind, plan["strange"].by) == ("ip", "user", "email", "values")
    assert [plan[c].action for c in ("severity", "message", "mystery", "old")] == ["keep", "text", "redact", "drop"]
    out = classify.apply_plan(df, list(plan.values()), KEYS).distinct().collect()
    good = next(r for r in out if r.severity == "5")
    bad = next(r for r in out if r.severity == "6")
    assert good.source_ip.startswith("198.1") and good.username.startswith("usr-") and "8.8.8.8" not in good.message and good.mystery == "[ELIDED]" and good.old == ""
    assert bad.source_ip == "[ELIDED]" and bad.username == "" and bad.mystery == ""
    assert classify.coverage(list(plan.values()))["unknown"] == ["mystery"]


def test_mail_and_html(spark, tmp_path):
    (tmp_path / "in.mbox").write_bytes(b"From a\nFrom: Bob <b@x.com>\nTo: c@x.com\nSubject: s\n\nbody\nFrom b\nFrom: d@x.com\nContent-Type: text/html\n\n<p>one</p><script>x</script><p>two&amp;</p>\n")
    got = documents.read_mbox(spark.read.format("binaryFile").load(str(tmp_path / "in.mbox"))).collect()
    assert [(r["from"], r.body.strip(), r.folder) for r in got] == [("b@x.com", "body", "in"), ("d@x.com", "one\n\ntwo&", "in")]
    assert documents.readable("<table><tr><td>a</td><td>b</td></tr></table>") == "a\tb" and documents.readable(None) is None


def test_docx(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {ns}><w:body><w:p><w:r><w:t>mail b@</w:t></w:r><w:r><w:t>x.com</w:t><w:tab/></w:r></w:p><w:p/></w:body></w:document>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("docProps/core.xml", "<c xmlns:d='u'><d:creator>Bob</d:creator></c>")
    (tmp_path / "a.docx").write_bytes(raw.getvalue())
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.docx"))
    paragraphs = documents.read_docx(files)
    assert [r.text for r in paragraphs.collect()] == ["mail b@x.com\t"]
    new = documents.write_docx(files, paragraphs.withColumn("text", F.lit("masked"))).first().content
    assert documents.docx_paragraphs(bytes(new))[0][2] == "masked\t" and b"Bob" not in zipfile.ZipFile(io.BytesIO(bytes(new))).read("docProps/core.xml")
