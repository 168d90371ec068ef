import io
import zipfile

import pandas as pd

from brindle.operators import faces, passages
from brindle.sources import readers, sinks
from brindle.streaming import windows

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_readers(spark, tmp_path):
    docx = packed({"word/document.xml": f'<w:document xmlns:w="{WORD}"><w:p><w:t>Hello</w:t></w:p><w:p><w:t>there</w:t></w:p></w:document>'})
    files = {
        "a.txt": "Grüße".encode("cp1252"), "b.html": b"<title>T</title><script>x()</script><p>one<br>two &amp; three</p>",
        "c.eml": b"From: Ann <a@x.com>\nTo: b@x.com, c@x.com\nSubject: Hi\n\nBody\n", "d.mbox": b"From x\nSubject: 1\n\nfirst\n\nFrom y\nSubject: 2\n\n>From here\n",
        "e.vcf": b"BEGIN:VCARD\nFN:Ann\nEMAIL;TYPE=work:A@x.com\nEND:VCARD\n", "f.zip": packed({"in/g.txt": "inner", "h.docx": docx}), "i.docx": b"broken",
        "j.bin": b"\x00\x01", "node_modules/k.txt": b"skipped", "~$l.txt": b"skipped", "m.csv": b'a,"b,c"\n',
    }
    for name, raw in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    rows = readers.documents(readers.walk(spark, f"file://{tmp_path}")).collect()
    got = {(r["path"].rpartition("/")[2], r["part"]): r for r in rows}
    assert got["a.txt", ""]["text"] == "Grüße" and got["m.csv", ""]["text"] == "a\tb,c"
    assert got["b.html", ""]["title"] == "T" and "x()" not in got["b.html", ""]["text"] and "two & three" in got["b.html", ""]["text"]
    assert got["c.eml", ""]["sender"] == "ann <a@x.com>" and got["c.eml", ""]["recipients"] == ["b@x.com", "c@x.com"]
    assert got["d.mbox", "1"]["title"] == "2" and got["d.mbox", "1"]["text"].startswith("From here")
    assert got["e.vcf", "0"]["recipients"] == ["a@x.com"] and got["f.zip", "in/g.txt"]["text"] == "inner" and got["f.zip", "h.docx"]["text"] == "Hello\nthere"
    assert got["i.docx", ""]["error"] and got["j.bin", ""]["error"].endswith("no reader")
    assert not any("skipped" in (r["text"] or "") for r in rows)


def test_sinks(spark, tmp_path):
    people = spark.createDataFrame([("Ann, B", "a@x.com", "X")], "name string, email string, company string")
    sinks.contacts_csv(people, f"{tmp_path}/csv", "google")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/csv").columns == ["Name", "E-mail 1 - Value", "Organization 1 - Name"]
    assert "FN:Ann\\, B" in sinks.vcards(people).first()[0]
    assert sinks.markdown(people, "People").splitlines()[-1] == "| Ann, B | a@x.com | X |"


def test_passages(spark):
    text = "\n\n".join(" ".join(f"word{i}x{j}" for j in range(40)) + "." for i in range(60))
    spans = passages.passages(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a < c <= b for (a, b), (c, _) in zip(spans, spans[1:], strict=False))
    rows = passages.chunk(spark.createDataFrame([(1, text), (2, None), (3, "short")], "id long, text string")).collect()
    assert all(text[r["start"] : r["end"]] == r["text"] for r in rows if r["id"] == 1) and [r["text"] for r in rows if r["id"] == 3] == ["short"]
    assert passages.passages("") == [] and passages.porter("meetings") == passages.porter("meeting")
    assert "needle" in passages.dense_window("hay " * 500 + "needle and needle " + "hay " * 500, ["needle"])


def test_faces(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 0), (4, [0.0, 0.0], 0)], "face long, v array<double>, block int")
    piles = spark.createDataFrame([(7, [1.0, 0.0]), (8, [1.0, 1.0])], "pile long, c array<double>")
    got = {r["face"]: (r["pile"], r["outcome"]) for r in faces.assign(rows, piles).collect()}
    assert got[1] == (7, "assigned") and got[3] == (8, "assigned") and got[4][1] == "open"
    assert {r["face"]: r["grp"] for r in faces.greedy(rows).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_streams_agree_with_batches(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = f"{tmp_path}/events"
    source.repartition(3).write.parquet(folder)
    stream = windows.tumbling(windows.timed(windows.event_stream(spark, folder, source.schema), "3650 days"), "1 day")
    running = stream.writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    running.awaitTermination(120)
    batch = windows.tumbling(windows.timed(source), "1 day")
    assert sorted(map(str, spark.table("days").collect())) == sorted(map(str, batch.collect()))


def test_bursts(spark, tmp_path):
    folder = f"{tmp_path}/changes"
    start = 1_700_000_000_000
    times = pd.to_datetime([start + t for t in (0, 1000, 1500, 9000, 60_000)], unit="ms", utc=True)
    spark.createDataFrame([("p", t.to_pydatetime()) for t in times], "path string, ts timestamp").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("path string, ts timestamp").parquet(folder).withWatermark("ts", "1 second")
    running = windows.bursts(stream).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    running.awaitTermination(120)
    got = sorted((r["first_ms"] - start, r["last_ms"] - start, r["n"]) for r in spark.table("bursts").collect())
    assert got[:2] == [(0, 1500, 3), (9000, 9000, 1)]
