from __future__ import annotations

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from proofset.llm import pii as op

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, match):
    digits = [int(c) for c in match if c.isascii() and c.isdigit()]
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if good(kind, m[0])]
    return ",".join(f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in sorted(spans))


def check(spark, frame, texts):
    rows = list(enumerate(texts))
    got = {r.id: r for r in op.find(frame(rows)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = brute(text)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (text[:200], want, got[i].spans)
        assert [got[i][f"n_{k}"] for k in PLAIN] == [len(re.findall(rf"{k}:", want)) for k in PLAIN]


def test_cases(spark, frame):
    check(
        spark,
        frame,
        [
            "write a.b+c@x-y.example.com, or a@b or a@b.c_d@e.f!",
            "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.002.3.255 ..1.2.3 1.1.1.1.",
            "4111 1111 1111 1111 and 4111-1111-1111-1112 and 378282246310005 5-5",
            "+1 (743) 555-3824, +4 9, +12345678901234567, ++1 743 555 3824",
            "é😀 +1 (743) 555-3824 漢字 a@b.co",
            "", None, "+", "@", "1.", "@@@ a@b.c@d.e", "4111111111111111.1.2.3",
            "١٢٣.1.1.1 １.２.３.４",
        ],
    )


def test_fuzz(spark, frame):
    rng = random.Random(4)
    alphabet = "0123456789" * 3 + "+-. ()@ab_%é\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(rng.choice("4111 -") for _ in range(40)) for _ in range(300)]
    check(spark, frame, texts)


def test_very_long_texts(spark, frame):
    """Runs that make a naive expression recurse or go over them again and again."""
    texts = ["1" * 150_000, "a" * 150_000, "1.1." * 40_000, "+1 2" * 40_000, "a." * 70_000 + "@", "a@" + "b." * 70_000]
    rows = list(enumerate(texts))
    got = {r.id: r for r in op.find(frame(rows)).collect()}
    assert got[0].spans == got[1].spans == got[4].spans == "" and got[2].n_ip == 20_000
    assert got[5].spans == "email:0:140001" and got[5].n_email == 1


def test_added_kinds(spark, frame):
    rows = [(1, "IBAN: GB82 WEST 1234 5698 7654 32 ok"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "his ssn is 123-45-6789"), (4, "code 123-45-6789")]
    got = {r.id: r for r in op.find(frame(rows)).collect()}
    assert "iban:6:33" in got[1].spans and "iban" not in got[2].spans
    assert got[3].spans == "ssn:11:22" and got[4].spans == ""


def test_context_raises_scores(spark, frame):
    rows = [(1, "my credit card 4111111111111111"), (2, "the sum of 4111111111111111")]
    got = {r.id: r.scores for r in op.find(frame(rows)).collect()}
    assert got == {1: "1.00", 2: "0.80"}


def test_redact(spark, frame, odd_rows):
    rows = [(1, "a@b.co and 1.2.3.4é!"), (2, None), (3, "+1 (743) 555-3824"), (4, "call +4111111111111111 now")]
    docs = frame(rows)
    out = op.redact(docs, count_col="n_chars")
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[1] == ("<email> and <ip>é!", 18) and got[2] == (None, None) and got[3][0] == "<phone>"
    assert got[4][0] in ("call +<card> now", "call <card> now", "call <phone> now")
    assert op.redact(frame(odd_rows)).count() == len(odd_rows)
    assert op.find(frame([])).count() == 0 and op.redact(frame([])).count() == 0


def seconds(df):
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def test_time_is_linear_in_spans(spark, frame):
    """Twice the spans in one text take about twice the time."""
    text = lambda n: " ".join(f"{i % 250}.1.2.3" for i in range(n))
    short, long = (frame([(1, text(n))], clashes=False) for n in (8_000, 16_000))
    for run in (op.find, op.redact):
        seconds(run(short))
        assert min(seconds(run(long)) for _ in range(2)) <= 2.2 * max(0.5, min(seconds(run(short)) for _ in range(2)))
    assert op.redact(long).first().text == " ".join(["<ip>"] * 16_000)
    spans = ",".join(f"ip:{m.start()}:{m.end()}" for m in re.finditer(PLAIN["ip"], text(16_000)))
    assert op.find(long).first().spans == spans


def test_overlapping_spans_become_one(spark, frame):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["+4111111111111111", " ", "1.2.3.4", "a@b.co", "é", "4111 1111 1111 1111", "x"]) for _ in range(rng.randrange(300))) for _ in range(40)]
    docs = frame(list(enumerate(texts))).withColumn("found_spans", F.lit("clash")).withColumn("__merged", F.lit("clash"))
    spans = {r.id: r.spans for r in op.find(docs).collect()}
    out = op.redact(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        runs = []
        for kind, a, b in ((k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans[r.doc_id].split(",") if x)):
            if runs and a < runs[-1][2]:
                runs[-1][2] = max(runs[-1][2], b)
            else:
                runs.append([kind, a, b])
        want, at = "", 0
        for kind, a, b in runs:
            want, at = want + texts[r.doc_id][at:a] + f"<{kind}>", b
        assert (r.text, r.found_spans) == (want + texts[r.doc_id][at:], "clash")


def test_plan_is_native(spark, frame):
    plan = op.find(frame([(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_parser_is_given_no_long_text(spark, frame, monkeypatch):
    """Nested expressions as SQL text left some 50 MB of the parser's states on the driver for good."""
    given, expr = [], F.expr
    monkeypatch.setattr(F, "expr", lambda text: given.append(len(text)) or expr(text))
    docs = frame([(1, "a@b.co and +1 (743) 555-3824")])
    assert op.redact(docs).first().text == "<email> and <phone>" and op.find(docs).first().spans == "email:0:6,phone:11:28"
    assert max(given, default=0) < 1000
