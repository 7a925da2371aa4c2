"""From files to an index, and everything asked of it, on a corpus of our own."""

import io
import json
import sys
import threading
import urllib.error
import urllib.request

import pytest

from quire import serve
from quire.cli import main, prompt
from quire.engine import Engine, load_session, pick, save_session
from quire.lifecycle import Store, newest, parse_remote, read_lock, resolve
from quire.operators.build import BuildError, build
from quire.plans.filters import Filters
from quire.sinks import publish
from quire.sources import corpus


def document(xml_id, *lines):
    body = "".join(f'<lb n="{n}"/>{t}\n' for n, t in lines)
    return f'<TEI xml:id="{xml_id}"><teiHeader><lb n="x"/></teiHeader><text><body><juan n="1"/>{body}</body></text></TEI>'


FILES = {
    "A/A12n0345.xml": document("A12n0345", ("0001a01", "月光如水照緇衣"), ("0001a02", "山中無甲子"), ("0001a05", "寒來不緣生草"), ("0001a09", "松下問童子"), ("0001b01", "雲深不知處")),
    "B/B01n0007.xml": document("B01n0007", ("0002a01", "長河落日圓，月光在水。"), ("0002a02", "大漠孤煙直")),
    "Y/Y01n0001.xml": document("Y01n0001", ("0001a01", "月光")),
}
CATALOG = [
    {"work_id": "A0345", "canon": "A", "path": "A/A12n0345.xml", "title": "山居集", "author": "某人", "work_type": "論", "category": None},
    {"work_id": "B0007", "canon": "B", "path": "B/B01n0007.xml", "title": "詩", "author": "王維"},
    {"work_id": "Y0001", "canon": "Y", "path": "Y/Y01n0001.xml", "title": "skipped"},
]


def write(root, files=FILES, catalog=CATALOG):
    scope = root / "scopes" / "mini"
    scope.mkdir(parents=True, exist_ok=True)
    (scope / "MANIFEST.json").write_text(json.dumps({"tag": "2026R2", "scope": "mini", "scope_hash": "h1", "label": "BED", "other": 1}))
    (scope / "catalog.jsonl").write_text("\n\n".join(json.dumps(c, ensure_ascii=False) for c in catalog) + "\n")
    (scope / "files.txt").write_text("# all\n\n" + "\n".join([*files, "Z/none.xml"]))
    for path, text in files.items():
        (root / "xml-p5" / path).parent.mkdir(parents=True, exist_ok=True)
        (root / "xml-p5" / path).write_text(text)


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    write(root)
    build(spark, str(root), "mini", str(root / "index"), golden="A12n0345_p0001a02")
    return root


@pytest.fixture(scope="module")
def engine(spark, place):
    return Engine.open(spark, str(place / "index"))


def ids(df):
    return [r["line_id"] for r in df.collect()]


def test_build(engine, place):
    assert engine.lines.count() == 7 and engine.info()["artifact_id"] == "2026R2+h1" and engine.info()["work_count"] == 2
    assert publish.read_current(place / "index") == "2026R2-h1"
    row = engine.lines.where("line_id = 'A12n0345_p0001a02'").first()
    assert (row["citation"], row["canon"], row["title"], row["dl"]) == ("(BED 2026.R2, A12, no. 0345, p. 1, a02)", "A", "山居集", 12)


def test_search(engine):
    assert set(ids(engine.search("月光"))) == {"A12n0345_p0001a01", "B01n0007_p0002a01"}
    assert ids(engine.search("缘生")) == ["A12n0345_p0001a05"]  # the other script finds it too
    assert ids(engine.search("月光", Filters(canons=("B",)))) == ["B01n0007_p0002a01"]
    assert set(ids(engine.search("月光 NEAR/4 水"))) == {"A12n0345_p0001a01", "B01n0007_p0002a01"}
    assert ids(engine.search("圓月")) == ["B01n0007_p0002a01"]  # punctuation does not part words
    assert ids(engine.search("月光-緇衣")) == ["B01n0007_p0002a01"]
    assert ids(engine.search("nothing")) == [] and ids(engine.search("，")) == []
    assert ids(engine.search("月", Filters(types=("論",)), extended=True)) == ["A12n0345_p0001a01"]


def test_gram_statistics_are_looked_up(engine):
    from quire.plans import match

    grams = {"月", "月光", "無", "none"[:2], "不"}
    assert engine.grams is not None and engine.statistics(grams) == match.statistics(engine.lines, grams)


def test_context_and_reading(engine):
    rows = engine.get("A12n0345_p0001a05", 1).collect()
    assert {(r["role"], r["line_id"]) for r in rows} == {("before", "A12n0345_p0001a02"), ("hit", "A12n0345_p0001a05"), ("after", "A12n0345_p0001a09")}
    assert len(engine.get("A12n0345_p0001a05", 0).collect()) == 1 and not engine.get("none", 3).collect()
    assert ids(engine.read("B0007", 1)) == ["B01n0007_p0002a01", "B01n0007_p0002a02"] and ids(engine.read("B0007", 2)) == []
    assert engine.cite("none") is None


def test_verify(engine, spark):
    report = engine.verify("山中无甲子。")
    assert report.is_original and report.exact_hit["line_id"] == "A12n0345_p0001a02" and report.similar == []
    report = engine.verify("山中無甲子如幻")
    assert not report.is_original and report.similar[0]["line_id"] == "A12n0345_p0001a02"
    assert not engine.verify("，").similar
    batch = engine.verify_batch(spark.createDataFrame([(1, "大漠孤烟直"), (2, "x"), (3, "")], "quote_id long, quote string")).collect()
    assert {r["quote_id"]: r["is_original"] for r in batch} == {1: True, 2: False, 3: False}


def test_catalog(engine):
    rows = engine.entries().collect()
    assert [r["work_id"] for r in rows] == ["A0345", "B0007"] and rows[0]["category"] == "" and rows[1]["dynasty"] == ""
    assert [r["work_id"] for r in engine.entries(Filters(authors=("王",))).collect()] == ["B0007"]


def test_session(engine, place):
    hits = [r.asDict() for r in engine.search("月光").collect()]
    save_session(engine, str(place), "月光", Filters(), hits)
    assert pick(load_session(engine, str(place))["hits"], 2) == hits[1]
    with pytest.raises(corpus.CorpusError):
        pick(hits, 3)
    saved = json.loads((place / "last.json").read_text())
    (place / "last.json").write_text(json.dumps(saved | {"artifact_id": "other"}))
    with pytest.raises(corpus.CorpusError):
        load_session(engine, str(place))


def test_incremental(spark, tmp_path):
    write(tmp_path)
    first = build(spark, str(tmp_path), "mini", str(tmp_path / "index"))
    changed = FILES | {"B/B01n0007.xml": document("B01n0007", ("0002a01", "新"))}
    write(tmp_path, changed, [CATALOG[0] | {"title": "renamed"}, *CATALOG[1:]])
    second = build(spark, str(tmp_path), "mini", str(tmp_path / "index"))
    assert first != second and first.exists() and publish.read_current(tmp_path / "index") == second.name
    parsed = spark.read.parquet(str(second / "parsed"))
    assert {r["path"] for r in parsed.select("path").distinct().collect()} == {"B/B01n0007.xml"}
    engine = Engine.open(spark, str(tmp_path / "index"))
    assert engine.lines.count() == 6 and {r["title"] for r in engine.lines.where("canon = 'A'").collect()} == {"renamed"}


def test_failed_build_changes_nothing(spark, tmp_path):
    write(tmp_path)
    build(spark, str(tmp_path), "mini", str(tmp_path / "index"))
    write(tmp_path, FILES | {"B/B01n0007.xml": "<TEI>"})
    with pytest.raises(BuildError):
        build(spark, str(tmp_path), "mini", str(tmp_path / "index"))
    with pytest.raises(BuildError):
        write(tmp_path)
        build(spark, str(tmp_path), "mini", str(tmp_path / "index"), golden="A12n0345_p9999z99")
    assert publish.read_current(tmp_path / "index") == "2026R2-h1"
    with publish.single_writer(tmp_path / "index"), pytest.raises(publish.Locked):
        build(spark, str(tmp_path), "mini", str(tmp_path / "index"))
    (tmp_path / "scopes" / "mini" / "files.txt").write_text("../x.xml")
    with pytest.raises(BuildError):
        build(spark, str(tmp_path), "mini", str(tmp_path / "index"))


def test_no_index(tmp_path, spark):
    with pytest.raises(corpus.NoIndex):
        corpus.active_artifact(str(tmp_path))
    (tmp_path / "a-b").mkdir()
    assert corpus.active_artifact(str(tmp_path)).name == "a-b"
    (tmp_path / "a-c.tmp").mkdir()
    (tmp_path / "a-c").mkdir()
    with pytest.raises(corpus.NoIndex):
        corpus.active_artifact(str(tmp_path))
    assert main(["search", "x", "--root", str(tmp_path / "none")], spark) == 2


def test_cli(place, spark, capsys):
    root = str(place / "index")
    assert main(["月光", "--json", "--save", "last", "--root", root], spark) == 0
    assert len(json.loads(capsys.readouterr().out)["hits"]) == 2
    assert main(["search", "--from", "last", "--index", "1", "--root", root], spark) == 0
    assert main(["nothing at all", "--root", root], spark) == 1
    assert main(["a＋b", "--root", root], spark) == 2
    capsys.readouterr()
    assert main(["search", "月光+水", "--explain", "--root", root], spark) == 0 and "near" in capsys.readouterr().out
    for argv in (["verify", "山中無甲子"], ["get", "A12n0345_p0001a05", "-C", "2"], ["read", "A0345", "1"], ["cite", "A12n0345_p0001a05"], ["catalog"], ["info"], ["completion"], ["bench", "月光", "--samples", "1"]):
        assert main([*argv, "--root", root], spark) == 0
    capsys.readouterr()
    for more, keys in (([], {"hit"}), (["-C", "1"], {"hit", "before", "after"})):
        assert main(["get", "A12n0345_p0001a05", "--json", *more, "--root", root], spark) == 0
        got = json.loads(capsys.readouterr().out)
        assert got.keys() == keys and got["hit"]["line_id"] == "A12n0345_p0001a05" and "role" not in got["hit"]
    assert main(["get", "A12n0345_p9999a05", "--json", "--root", root], spark) == 1 and json.loads(capsys.readouterr().out) == {"hit": None}
    for shell in ("bash", "zsh", "fish"):
        assert main(["completion", shell], spark) == 0 and "verify" in capsys.readouterr().out
    assert main(["completion", "csh"], spark) == 2
    assert main(["nonsense-verb-less", "--mode", "fuzzy", "--root", root], spark) == 2


def test_terms_are_marked(engine, place, spark, capsys, monkeypatch):
    root = str(place / "index")
    texts = engine.spark.createDataFrame([("天上月光明",), ("無月",)], "text_raw string")
    assert [r[0] for r in engine.marked(texts, ["", "没有", "无", "月光"], "<", ">").collect()] == ["天上<月光>明", "<無>月"]
    assert main(["月光", "--root", root], spark) == 0 and "\x1b" not in capsys.readouterr().out
    monkeypatch.setattr(type(sys.stdout), "isatty", lambda self: True, raising=False)
    assert main(["月光", "--root", root], spark) == 0
    assert capsys.readouterr().out.count("\x1b[1;31m月光\x1b[0m") == 2
    assert main(["月光", "--plain", "--root", root], spark) == 0 and "\x1b" not in capsys.readouterr().out
    assert main(["月光", "--script", "s", "--json", "--root", root], spark) == 0 and len(json.loads(capsys.readouterr().out)["hits"]) == 2


def test_prompt(engine, place, capsys):
    root = str(place / "index")
    assert prompt(engine, root, ["月光\n", ":copy 1\n", ":open 1\n", ":scope\n", ":verify 山中無甲子\n", ":open 9\n", ":q\n", "never\n"]) == 0
    out = capsys.readouterr()
    assert "卷1：" in out.out and "original" in out.out and "no hit 9" in out.err


def test_http(engine):
    web = serve.serve_in_thread(engine)

    def post(path, body, headers={}):
        request = urllib.request.Request(f"http://127.0.0.1:{web.server_port}{path}", body, {"Content-Type": "application/json"} | headers)
        try:
            with urllib.request.urlopen(request, timeout=60) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as problem:
            return problem.code, json.load(problem)

    assert [len(post("/search", json.dumps(b).encode())[1]["hits"]) for b in ({"q": "月光"}, {"clauses": ["月光", "水"]}, {"q": "none"})] == [2, 2, 0]
    assert post("/search", b"{")[0] == 400 and post("/search", json.dumps({"q": "a＋b"}).encode())[0] == 400 and post("/search", b"{}")[0] == 400
    assert post("/other", b"{}")[0] == 404 and post("/search", b"{}", {"Host": "evil.example"})[0] == 403
    told = post("/mcp", json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "info", "arguments": {}}}).encode())[1]
    assert json.loads(told["result"]["content"][0]["text"])["tag"] == "2026R2"
    found = []
    threads = [threading.Thread(target=lambda: found.append(post("/search", json.dumps({"q": "月光"}).encode())[0])) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert found == [200] * 8
    web.shutdown()
    empty = serve.serve_in_thread(None)
    request = urllib.request.Request(f"http://127.0.0.1:{empty.server_port}/search", b'{"q": "x"}')
    with pytest.raises(urllib.error.HTTPError) as problem:
        urllib.request.urlopen(request, timeout=10)
    assert problem.value.code == 503
    empty.shutdown()
    with pytest.raises(ValueError):
        serve.check_bind("0.0.0.0")


def test_tools(engine):
    ask = lambda name, **a: {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}}
    messages = [{"jsonrpc": "2.0", "id": 0, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 1, "method": "tools/list"}]
    messages += [ask("search", q="月光"), ask("verify_quote", quote="山中無甲子"), ask("get_passage", action="get", line_id="A12n0345_p0001a05", context=1), ask("get_passage", action="cite", line_id="A12n0345_p0001a05"), ask("catalog", works=["B0007"]), ask("nope"), {"id": 9, "method": "x"}]
    out = io.StringIO()
    serve.serve_stdio(engine, [json.dumps(m) for m in messages] + ["{", " "], out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(replies) == 10 and len(replies[1]["result"]["tools"]) == 5
    known = {t["name"]: t["inputSchema"] for t in replies[1]["result"]["tools"]}
    assert all(t["type"] == "object" for t in known.values()) and known["verify_quote"]["required"] == ["quote"] and "clauses" in known["search"]["properties"]
    passage = json.loads(replies[4]["result"]["content"][0]["text"])
    assert passage["hit"]["line_id"] == "A12n0345_p0001a05" and len(passage["before"]) == len(passage["after"]) == 1
    assert replies[7]["result"]["isError"] and replies[8]["error"]["code"] == -32601 and replies[9]["error"]["code"] == -32700


def test_releases(tmp_path):
    listing = "a1\trefs/tags/2026R2\nb2\trefs/tags/2026R2^{}\nc3\trefs/tags/master\nd4\trefs/tags/xml-p5-2018-1\ne5\trefs/heads/x\nf6\trefs/tags/2025R1\n"
    assert parse_remote(listing) == {"2026R2": "b2", "2025R1": "f6"}
    assert newest(["2026R2", "2026R10", "2025R99", "x"]) == "2026R10"
    (tmp_path / "lock").write_text("releases:\n  2026R2:\n    xml: abc\n    catalog: def # x\n  2025R1:\n    xml: 123\n")
    pinned = read_lock(str(tmp_path / "lock"))
    assert pinned["2026R2"] == {"xml": "abc", "catalog": "def"} and resolve("latest", pinned) == "2026R2"
    with pytest.raises(corpus.CorpusError):
        resolve("1999R1", pinned)


def test_store(tmp_path):
    write(tmp_path / "source")
    store = Store(str(tmp_path / "store"))
    for tag in ("2025R1", "2026R2"):
        store.fetch(tag, str(tmp_path / "source"))
        store.fetch(tag, str(tmp_path / "source"))
    assert store.current() is None and store.use("2025R1") == "2025R1"
    assert store.pull(["2025R1", "2026R2"]) == {"current": "2025R1", "latest": "2026R2", "behind": True}

    def failing(_path):
        raise corpus.CorpusError("no")

    with pytest.raises(corpus.CorpusError):
        store.use("2026R2", failing)
    with pytest.raises(corpus.CorpusError):
        store.use("2024R1")
    with pytest.raises(corpus.CorpusError):
        store.use("2026R2", pinned={"xml": "abc"})
    assert store.current() == "2025R1" and store.prune(dry=True) == ["2026R2"] and store.tags() == ["2025R1", "2026R2"]
    with pytest.raises(corpus.CorpusError):
        store.prune(["2025R1"])
    assert store.prune() == ["2026R2"] and store.tags() == ["2025R1"]
