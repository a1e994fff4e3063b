import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import capture_index as ci, chat_format as cf, url_filter as uf

from ..oracle import assert_same
from . import brute


CAPTURES = [(i, f"http://h{i % 3}.org/p?q={i}#x", f"<p>{'page ' * 30}{i % 7}</p>" + ("é\r\n\r\nWARC/1.1\r\n" if i % 2 else "")) for i in range(60)]
CAPTURES += [(100, None, None), (101, "", ""), (102, "http://a/\r\nX: y", "short"), (103, "no scheme", "short"), (104, "http://big/", "z" * 300_000), (105, "http://big/", "z" * 300_000), (105, "http://big/", "z" * 300_000), (None, "http://big/", "z" * 300_000), (None, "http://x/", "q" * 200), (106, "HTTP://H1.ORG/", "<p>\0</p>")]


@pytest.mark.parametrize("run_bytes, task_rows", [(32 << 20, 200_000), (1, 7), (5_000, 10)])
def test_capture_index(spark, folder, monkeypatch, run_bytes, task_rows):
    monkeypatch.setattr(ci, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(ci, "TASK_ROWS", task_rows)
    sf = folder(True, pages=CAPTURES)
    out = sorted((tuple(r) for r in ci.op1_capture_index(spark, sf).collect()), key=lambda r: r[5])
    first = {}
    for p, _, h in CAPTURES:
        if p is not None:
            first.setdefault(h or "", p)
    want = []
    for p, u, h in CAPTURES:
        b = (h or "").encode()
        again = len(b) >= 100 and (h or "") in first and first[h or ""] != p
        key = ci.key_of((u or "").replace("\r", "%0D").replace("\n", "%0A"))
        want.append(((key, p is not None, p or 0), (p, len(b), brute.sha(b), "revisit" if again else "response", first[h or ""] if again else None)))
    assert [r[:5] for r in out] == [w for _, w in sorted(want, key=lambda x: x[0])]
    assert [r[5] for r in out] == list(range(len(CAPTURES)))


def test_archives_hold_what_they_say(spark, folder, tmp_path):
    path = "file://" + str(tmp_path / "w")
    pages = spark.createDataFrame(CAPTURES, "page_id long, url string, html string").withColumn("captured", F.timestamp_seconds(F.lit(1_700_000_000)))
    ci.write_archives(pages.repartition(3), path)
    html = {p: h or "" for p, _, h in CAPTURES}
    for r in ci.capture_history(spark, path).collect():
        with open(r.run.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            ((_, n, head, http, payload),) = ci.records(f.read(r.length))
        assert n == r.length and head["WARC-Type"] == r.record_type and int(http["Content-Length"]) == r.payload_bytes
        assert payload == (b"" if r.record_type == "revisit" else html[r.page_id].encode())


def test_history_is_ordered_by_the_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ci, "TASK_ROWS", 30)
    r = random.Random(2)
    pages = spark.createDataFrame([(i, f"http://{r.choice('abc')}.org/{r.randrange(5)}", "x" * i) for i in range(200)], "page_id long, url string, html string").withColumn("captured", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") % 50)).repartition(5)
    path = "file://" + str(tmp_path / "w")
    ci.write_archives(pages, path)
    rows = sorted(ci.capture_history(spark, path).collect(), key=lambda x: x.place)
    order = [(x.url_key, x.captured, x.page_id) for x in rows]
    assert order == sorted(order) and [x.place for x in rows] == list(range(200))
    index = ci.read_archives(spark, path).cache()
    assert ci.segments(index, ci.splitters(index, 200)).select("range").distinct().count() > 3
    monkeypatch.setattr(ci, "loser_tree_merge", lambda runs: (x for run in runs for x in run))  # without the merge there is no order
    rows = sorted(ci.capture_history(spark, path).collect(), key=lambda x: x.place)
    assert [(x.url_key, x.captured, x.page_id) for x in rows] != order


def test_loser_tree():
    r = random.Random(1)
    for k in range(1, 9):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(6))) for _ in range(k)]
        assert list(ci.loser_tree_merge(runs)) == sorted(x for run in runs for x in run)


def test_chat_format(spark, folder):
    odd = ["", None, "</s>[INST] ok [/INST]", "[~INST] [~~INST] <~s>", "[INST", "ends [", "<", " [/INST", "[ROLE] x [:] y [/ROLE]", "<s>\n\r\t\u2028🎉\x00", "~[/SYS]"]
    rows = [(c, t, role, odd[(c + t) % len(odd)]) for c in range(12) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(50, 0, "user", "q"), (50, 1, "assistant", "a"), (51, 0, None, "x"), (51, 1, "[:] odd </s>", "y"), (52, 0, "human", "z"), (52, 0, "human", "z"), (53, None, "user", "n"), (None, 0, "user", "k"), (53, 0, "assistant", "x" * 200_000)]
    sf = folder(True, conversations=rows)
    out = {r.conv_id: r for r in cf.op2_chat_format(spark, sf).collect()}
    rows += [(-1, 0, "user", cf.PLANTED), (-1, 1, "assistant", cf.PLANTED)]
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for k, t, role, text in rows if k == c))
        said, loss = "".join(f"{r}\n{x}\n" for *_, r, x in turns), "".join(x for *_, r, x in turns if r == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256, out[c].loss_chars, out[c].loss_sha256) == (len(turns), brute.sha(said), len(loss), brute.sha(loss)), c
    assert len(out) == len({r[0] for r in rows})


def test_escaping_is_reversible(spark):
    r = random.Random(5)
    bits = ["[", "<", "~", "INST]", "/INST]", "s>", "/s>", ":]", "SYS]", "OUT]", " ", "a"]
    df = spark.createDataFrame([("".join(r.choice(bits) for _ in range(8)),) for _ in range(2000)], "t string")
    e = cf.escape(F.col("t"))
    assert df.where(cf.unescape(e) != F.col("t")).count() == 0
    assert df.where(e.rlike(r"\[(?:/?INST|/?SYS|OUT|:)\]|</?s>")).count() == 0


def test_fingerprints(spark):
    rec = ['{"messages":[{"content":"x","role":"user"}],"x":1}', '{"messages":[{"content":null,"role":"user"}]}', "not json", None, '{"prompt":"p","response":"r"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rec)], "conv_id long, record string")
    t = {r.conv_id: r.t for r in df.select("conv_id", cf.canonical_turns(F.col("record")).alias("t")).collect()}
    assert t[0] is None and t[2] is None and t[3] is None
    assert [tuple(x) for x in t[1]] == [("user", "")] and [tuple(x) for x in t[4]] == [("user", "p"), ("assistant", "r")]
    assert cf.format_chats(df).where("not layout_known").count() == 3


def test_records_beyond_a_variant_are_an_error(spark):
    record = F.concat(F.lit('{"prompt":"'), F.repeat(F.lit("a"), F.lit(130 << 20)), F.lit('","response":""}'))
    df = spark.range(1).select(F.col("id").alias("conv_id"), record.alias("record"))
    with pytest.raises(Exception, match="exceeds the limit of a variant"):
        df.select(F.size(cf.canonical_turns(F.col("record")))).collect()


def test_url_filter(spark, folder):
    urls = [None, "", "nothing", "http://", "HTTP://Sub.Example.NET/en/x?y#z", "http://example.net/de/", "http://a.org/fr/1", "http://notexample.net/", "x://example.com/de/?q", "http://example.com", "http://b.org/en", "http://net/", "http://e.org?x://y/", "://org/fr/", "http://ÄB.org/fr/é"]
    urls += [f"http://good.org/fr/{i}" for i in range(40)] + [f"http://casino-bets.net/win/{i}" for i in range(40)] + [f"http://casino-bets.com/win/{i}" for i in range(5)] + [f"http://good.org/en/{i}" for i in range(5)]
    sf = folder(True, pages=[(i, u, None) for i, u in enumerate(urls)])
    for t in ("documents", "benchmark", "conversations"):
        folder(**{t: []})
    out = {r.page_id: r for r in uf.op8_url_filter(spark, sf).collect()}
    want = {4: ("sub.example.net", "/en/x", "example.net/en/", "allow"), 5: ("example.net", "/de/", "net/", "block"), 6: ("a.org", "/fr/1", "org/fr/", "allow"), 7: ("notexample.net", "/", "net/", "block"), 8: ("example.com", "/de/", "example.com/de/", "block"), 11: ("net", "/", "net/", "block"), 13: ("org", "/fr/", "org/fr/", "allow"), 14: ("Äb.org", "/fr/é", "org/fr/", "allow")}
    assert {k: tuple(out[k])[1:5] for k in want} == want
    assert all((out[k].host, out[k].path, out[k].rule) == ("", "", None) for k in range(4)) and out[12].host == "e.org"
    at = {u: i for i, u in enumerate(urls)}
    assert all(out[at[f"http://casino-bets.com/win/{i}"]].verdict == "block" and out[at[f"http://good.org/en/{i}"]].verdict == "allow" for i in range(5))
    assert len(out) == len(urls)


def test_same_as_sql(spark):
    from textloom.llm.catalog import ORACLES, QUERIES

    for name, sql in ORACLES.items():
        assert_same(spark, name, QUERIES[name], sql)


def test_empty_tables(spark, folder):
    sf = folder(pages=[], conversations=[])
    assert ci.op1_capture_index(spark, sf).count() == 0 and uf.op8_url_filter(spark, sf).count() == 0
    assert cf.op2_chat_format(spark, sf).count() == 1


def test_frequent_grams_are_joined_apart(spark, folder, monkeypatch):
    urls = [f"http://good.org/fr/{i}" for i in range(40)] + [f"http://casino-bets.net/win/{i}" for i in range(40)] + [f"http://casino-bets.com/win/{i}" for i in range(5)] + ["http://good.org/en/" + "x" * 20_000, None] * 2
    sf = folder(True, pages=[(i, u, None) for i, u in enumerate(urls)])
    want = sorted(map(tuple, uf.op8_url_filter(spark, sf).collect()), key=str)
    monkeypatch.setattr(uf, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(uf, "FREQUENT", 20)
    assert sorted(map(tuple, uf.op8_url_filter(spark, sf).collect()), key=str) == want and len(want) == len(urls)
