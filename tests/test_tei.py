import pytest

from quire.sources.tei import TeiError, parse_lines, read_lines

DOC = """<?xml version="1.0"?><TEI xml:id="A12n0345"><teiHeader><lb n="9999z99"/><p>head</p></teiHeader><text><body>
<cb:juan xmlns:cb="u" n="001"/>lost<lb n="0001a01"/>first <app><lem>kept</lem><rdg>not</rdg></app> &amp; &#x6708;<note>said</note>
<lb n="0001a02"></lb><![CDATA[raw <x>]]><lb n="0001a03"/>late<milestone unit="juan" n="2"/>
<lb/>dropped<lb n="0001a04"/><g ref="#X"/> </body></text></TEI>"""


def test_lines():
    assert parse_lines(DOC) == [
        ("A12n0345_p0001a01", "A0345", 1, "first kept & 月said", "0001a01"),
        ("A12n0345_p0001a02", "A0345", 1, "raw <x>", "0001a02"),
        ("A12n0345_p0001a03", "A0345", 2, "late", "0001a03"),
        ("A12n0345_p0001a04", "A0345", 2, "", "0001a04"),
    ]


@pytest.mark.parametrize("bad", ["<TEI xml:id='a'><body><lb n='1'/>&nope;</body></TEI>", "<TEI><body><lb n='1'/>x</body></TEI>", "<TEI xml:id='a'><body>", "", "<p>html<br></p>"])
def test_errors(bad):
    with pytest.raises(TeiError):
        parse_lines(bad)


def test_bytes_and_prefixes():
    assert parse_lines(b"<tei id='Bn1'><body><lb n='a'/>x\xff</body></tei>") == [("Bn1_pa", "B1", 0, "x�", "a")]
    assert parse_lines("<TEI xml:id='Bn1'><body><lb n='a'/>x<juan n='x1'/></body></TEI>")[0][2] == 0


def test_broken_files_are_rows(spark):
    rows = read_lines(spark.createDataFrame([("a.xml", bytearray(DOC.encode())), ("b.xml", bytearray(b"<p>")), ("c.xml", None)], "path string, content binary")).collect()
    assert sum(r["error"] is None for r in rows) == 4 and {r["path"] for r in rows if r["error"]} == {"b.xml", "c.xml"}


def test_stream(spark, tmp_path):
    from quire.streaming.corpus_stream import append_to, read_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(DOC)
    for expected in (4, 8):
        append_to(read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == expected
        (tmp_path / "in" / "b.xml").write_text(DOC.replace("A12n0345", "A13n0001"))
