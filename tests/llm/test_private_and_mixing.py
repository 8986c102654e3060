"""Pseudonyms and mixing against plain Python versions; the pipeline stage by stage."""

import datetime
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from seaway.llm import mixing, private

PLAN = "route_id long, plan_text string"


def plain_feistel(values, radices, kind, secret="seaway"):
    v, half = list(values), len(values) // 2
    for n in range(private.ROUNDS):
        left = n % 2 == 0
        source = v[half:] if left else v[:half]
        base = f"{secret}|{n}|{kind}|{','.join(map(str, source))}|"
        draw = lambda i: int(hashlib.sha256(f"{base}{i}".encode()).hexdigest()[:12], 16)  # noqa: E731, B023
        v = [(x + draw(i)) % radices[i] if (i < half) == left else x for i, x in enumerate(v)]
    return v


def luhn_ok(s):
    d = [int(c) for c in reversed(s) if c.isdigit()]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def replaced(spark, rows):
    plans = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], PLAN)
    got = private.pseudonymise(plans).orderBy("route_id").collect()
    return [r.plan_text for r in got], [r.private_kinds for r in got]


VALUES = {
    "card": "4111 1111-1111 1111", "iban": "DE89 3704 0044 0532 0130 00", "ship": "IMO 9074729", "date": "2019-02-28", "ip": "78.181.149.139",
    "ssn": "123-45-6789", "phone": "+1 (612) 555-4887", "email": "ann.b-42@mail3.example.com", "key": 'token = "0641917ea4e9feb9cda83477b57ac2654884f485"',
}


def test_every_kind_keeps_its_format(spark):
    got, kinds = replaced(spark, [f"See {v}, end." for v in VALUES.values()])
    assert kinds == [[k] for k in VALUES]
    out = dict(zip(VALUES, (g[4:-6] for g in got), strict=True))
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s)))
    for k, v in VALUES.items():
        assert out[k] != v
        if k not in ("ip", "key"):
            assert shape(out[k]) == shape(v)
    assert luhn_ok(out["card"]) and out["card"][0] == "4"
    moved = (out["iban"].replace(" ", "")[4:] + "DE" + out["iban"][2:4])
    assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    n = out["ship"][4:]
    assert sum(int(c) * (7 - i) for i, c in enumerate(n[:6])) % 10 == int(n[6])
    assert datetime.date(1900, 1, 1) <= datetime.date.fromisoformat(out["date"]) <= datetime.date(2099, 12, 31)
    assert all(0 <= int(o) < 256 for o in out["ip"].split("."))
    a, g, s = (int(x) for x in out["ssn"].split("-"))
    assert 0 < a < 900 and a != 666 and g and s
    assert out["phone"].startswith("+1 (") and out["email"].endswith("@mail3.example.com")
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out["key"])


def test_values_against_a_plain_feistel(spark):
    got, _ = replaced(spark, ["4111111111111111", "78.181.149.139", "1900-01-01", "123-45-6789"])
    free = plain_feistel([1] * 14, [10] * 14, "card")
    assert got[0][:15] == "4" + "".join(map(str, free)) and luhn_ok(got[0])
    assert got[1] == ".".join(map(str, plain_feistel([78, 181, 149, 139], [256] * 4, "ip")))
    a, b = plain_feistel([0, 0], private.DAYS, "date")
    assert got[2] == str(datetime.date(1900, 1, 1) + datetime.timedelta(a * private.DAYS[1] + b))
    a, g, s = plain_feistel([122, 44, 6788], [898, 99, 9999], "ssn")
    assert got[3] == f"{a + (2 if a >= 665 else 1):03d}-{g + 1:02d}-{s + 1:04d}"


def test_equal_values_stay_linked_and_different_ones_apart(spark):
    days = [(datetime.date(1900, 1, 1) + datetime.timedelta(37 * i)).isoformat() for i in range(900)]
    got, _ = replaced(spark, ["a 4111111111111111 b 4111-1111-1111-1111", *days])
    one, two = re.fullmatch("a ([0-9]+) b ([0-9-]+)", got[0]).groups()
    assert one == two.replace("-", "")
    assert len(set(got[1:])) == len(days)


def test_invalid_and_plain_text_stays(spark):
    rows = ["4111111111111112", "999.1.1.1 and 1.2.3", "2019-02-30", "000-12-3456", "DE00370400440532013000", "IMO 9074728", "License, Version 2.0.", "", "no value, just words @ sea", "12345"]
    got, kinds = replaced(spark, rows)
    assert got == rows and not any(kinds)


def test_private_takes_odd_rows(spark):
    long = "calm sea " * 100_000 + "10.1.2.3"
    plans = spark.createDataFrame([(1, None, "x"), (2, long, "y"), (2, long, "y"), (None, "10.1.2.3 10.1.2.3", None)], PLAN + ", private_kinds string")
    got = private.pseudonymise(plans).collect()
    by = {r.plan_text and len(r.plan_text): r for r in got}
    assert None in by and len(got) == 4
    pair = next(r for r in got if r.route_id is None)
    assert pair.private_kinds == ["ip", "ip"] and len(set(pair.plan_text.split(" "))) == 1
    assert all(r.plan_text.endswith(pair.plan_text.split(" ")[0]) for r in got if r.route_id == 2)
    assert private.pseudonymise(spark.createDataFrame([], PLAN)).count() == 0


def test_private_is_native(spark):
    plan = private.pseudonymise(spark.createDataFrame([(1, "a")], PLAN))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_mix(rows, weights=(3, 1, 2), share=1.5, cap=2.0):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    w = {s: weights[n % 3] for n, s in enumerate(sources)}
    target, left = {s: 0.0 for s in sources}, share * sum(total.values())
    free = set(sources)
    while left > 1e-9 and free:  # share by weight, stop at the cap, share the excess again
        each = left / sum(w[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += each * w[s]
            if target[s] >= cap * total[s]:
                left += target[s] - cap * total[s]
                target[s] = cap * total[s]
                free.discard(s)
    taken = {}
    for s in sources:
        own = [(i, t) for i, t, x in rows if x == s]
        epochs = int(target[s] / total[s] + 1e-12) if total[s] else 0
        budget = round(target[s]) - epochs * total[s]

        def key(row):
            i, t = row
            u = (int(hashlib.md5(f"mix|{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            n = len(t or "")
            q = 0.05 + 0.95 * (sum(c not in mixing.SIGNS for c in t) / n) if n else 0.05
            return -math.log(u) / q

        for i, t in sorted(own, key=key):
            part = min(size[i], max(0, budget))
            budget -= part
            taken[i] = epochs * size[i] + part
    return size, target, taken


@pytest.mark.parametrize("bucket,broadcast", [(4096, 10_000), (3, 0)])
def test_mix_equals_plain_version(spark, monkeypatch, bucket, broadcast):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rows = [(i, "wörd #1\t" * (i * i % 23) + "end", ["TRACKED", "GROUNDED", "ÄRCTIC", None, "tiny"][0 if i % 3 == 0 else i % 5]) for i in range(120)]
    rows += [(500, None, "TRACKED"), (501, " ", "empty"), (502, "", None)]
    plans = spark.createDataFrame([(*r, "clash") for r in rows], PLAN + ", source string, target string")
    got = {r.route_id: r for r in mixing.mix_sources(plans).collect()}
    size, target, taken = plain_mix(rows)
    assert {i: r.size for i, r in got.items()} == size
    assert all(abs(got[i].target - target[s]) < 1e-6 for i, _, s in rows)
    assert {i: r.taken for i, r in got.items()} == taken
    assert all(r.taken <= 2 * r.size for r in got.values())


def test_copies_of_the_mix(spark):
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(i + 1)), "a" if i % 2 else "b") for i in range(30)]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, PLAN + ", source string"))
    words = mixing.repeat_taken(mixed).groupBy("route_id").agg(F.sum(F.size(F.split("plan_text", " "))).alias("n"))
    assert {r.route_id: r.n for r in words.collect()} == {r.route_id: r.taken for r in mixed.collect() if r.taken}


def test_mix_of_odd_tables(spark):
    kind = PLAN + ", source string"
    assert mixing.mix_sources(spark.createDataFrame([], kind)).count() == 0
    none = mixing.mix_sources(spark.createDataFrame([(1, None, None), (2, "", "a")], kind)).collect()
    assert [r.taken for r in none] == [0, 0]
    twice = mixing.mix_sources(spark.createDataFrame([(1, "a b", "x")] * 6 + [(None, "c", "x")], kind)).collect()
    assert sum(r.taken for r in twice) in range(18, 21) and all(r.taken <= 2 * r.size for r in twice)


def test_mix_is_native(spark):
    plans = spark.createDataFrame([(1, "a", "s")], PLAN + ", source string")
    plan = mixing.mix_sources(plans)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(12)
    word = lambda *_: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    clean = [f"calm sea {word(i, 99)} " + " ".join(word(i, j) for j in range(40)) for i in range(40)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(clean)]
    rows += [(100 + i, clean[i] if i % 2 else clean[i] + " more", "en", "src0", 0) for i in range(10)]  # copies and near copies
    rows += [(200 + i, f"north {word(i, 77)} you idiot moron " + " ".join(word(i + 50, j) for j in range(20)), "en", "src1", 0) for i in range(12)]
    rows += [(300, None, None, None, None), (301, "", "en", "src2", 0), (302, "write ann.b@mail.example.com or 10.2.3.4 now please", "en", "src2", 0), (39, clean[39], "en", "src0", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(i, 1, 0) for i in range(40)] + [(200 + i, 1, 1) for i in range(12)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_copies", "private", "mixing", "pieces"]
    kept = cp.drop_toxic(spark, docs.withColumn("toxicity", F.lit("clash")), str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows if not 200 <= r[0] < 212}
    one = cp.drop_near_copies(spark, kept, str(tmp_path))
    ids = sorted(r.doc_id for r in one.collect())
    assert ids == sorted([*range(40), 300, 301, 302])
    safe = cp.replace_private(spark, one, str(tmp_path))
    text = {r.doc_id: r.text for r in safe.collect()}
    assert "ann.b" not in text[302] and "10.2.3.4" not in text[302] and text[0] == clean[0] and text[300] is None
    mixed = cp.mix(spark, safe, str(tmp_path))
    total = sum(len(t.split()) for t in text.values() if t)
    assert abs(sum(len(r.text.split()) for r in mixed.collect()) - 1.5 * total) <= 4
    last = cp.encode(spark, mixed, str(tmp_path))
    assert last.count() == mixed.count() and last.filter("n_pieces = 0").count() == 0
    whole = cp.run(spark, str(tmp_path))
    assert whole.count() == last.count()
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


@pytest.mark.parametrize("tail", ["", " 123", " 12/27", " 42", " 2024", " BIC", " EUR", " 123 Main"])
def test_values_before_numbers_and_upper_case_words(spark, tail):
    values = {**VALUES, "phone": "+1 (017) 555-7713"}
    more = [("phone", "555-123-4567"), ("card", "4111 1111 1111 1111"), ("card", "4111111111111111"), ("iban", "AT611904300234573201"), ("iban", "BE68 5390 0754 7034")]
    pairs = [*values.items(), *more]
    alone, _ = replaced(spark, [v for _, v in pairs])
    got, kinds = replaced(spark, [v + tail for _, v in pairs])
    assert kinds == [[k] for k, _ in pairs]
    assert got == [a + tail for a in alone]


def test_search_goes_on_behind_a_shorter_form(spark):
    alone, _ = replaced(spark, ["4111 1111 1111 1111", "555-123-4567"])
    got, kinds = replaced(spark, ["4111 1111 1111 1111 555-123-4567", "12 4111 1111 1111 1111", "555-123-4567 555-123-4567 " * 400])
    assert got[0] == " ".join(alone) and kinds[0] == ["card", "phone"]
    assert got[1] == "12 " + alone[0]
    assert got[2] == f"{alone[1]} {alone[1]} " * 400 and len(kinds[2]) == 800


def test_keys_to_their_end_and_with_prefixes(spark):
    long, jwt = "aB3dE6gH" * 25, "eyJhbGciOi.eyJzdWIiOiIx.SflKxwRJSMeKKF2QT4"
    secret = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    heads = ["access_token=", "aws_secret_access_key = ", "db_password=", "--password=", '{"password": "', "{'api-key': '", "my.token: ", "SECRET_KEY="]
    rows = [h + v for h in heads for v in (long, jwt, secret)]
    got, kinds = replaced(spark, [f"{r}, end" for r in rows] + ["token=" + "x1" * 20_000])
    assert kinds == [["key"]] * (len(rows) + 1)
    for r, g in zip(rows, got, strict=False):
        h = next(h for h in heads if r.startswith(h))
        new = g[len(h) : -len(", end")]
        assert g.startswith(h) and g.endswith(", end") and len(g) == len(r) + 5
        for a, b in zip(re.findall("[A-Za-z0-9]+", r[len(h) :]), re.findall("[A-Za-z0-9]+", new), strict=True):
            assert a != b and (len(a) < 16 or a[-8:] != b[-8:])
    assert got[-1][-8:] != "x1" * 4 and len(got[-1]) == 40_006
    dotted, _ = replaced(spark, ["token=0641917ea4e9feb9cda83477b57ac265.", "token=0641917ea4e9feb9cda83477b57ac265"])
    assert dotted[0] == dotted[1] + "."


def test_numbers_behind_signs_and_letters(spark):
    alone, _ = replaced(spark, ["4111111111111111", "123-45-6789", "10.1.2.3", "2019-02-28", "DE89370400440532013000"])
    heads = ["no.", "card-", "x_", "id="]
    got, kinds = replaced(spark, [h + v for h in heads for v in ("4111111111111111", "123-45-6789", "10.1.2.3", "2019-02-28", "DE89370400440532013000")])
    assert kinds == [["card"], ["ssn"], ["ip"], ["date"], ["iban"]] * 4
    assert got == [h + a for h in heads for a in alone]
    rows = ["0.4111111111111111", "1.2.3.4.5", "v1.2.3.4", "3fa4111111111111111b", "12-123-45-6789-1"]
    assert replaced(spark, rows) == (rows, [[]] * len(rows))
    assert replaced(spark, ["card4111111111111111"])[0] == ["card" + alone[0]]


def test_near_copies_of_repeated_ids_go_row_by_row(spark, tmp_path):
    import corpus_pipeline as cp

    a, b, c = (" ".join(f"{k}{j}" for j in range(40)) for k in "abc")
    rows = [(5, a, "en", "s", 1), (7, a, "en", "s", 2), (7, b, "en", "s", 3), (7, b, "en", "s", 3), (9, c, "en", "s", 4), (9, c + " more", "en", "s", 5), (3, c, "en", "s", 6),
            (None, a, "en", "s", 7), (11, None, "en", "s", 8), (12, b + " more", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.drop_near_copies(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(r.n_chars for r in got.collect()) == [1, 3, 6, 7, 8]


def test_part_of_a_text_keeps_its_layout(spark):
    text = "\t# one\n\n  two  three\r\n\tfour five\n"
    mixed = spark.createDataFrame([(1, text, 6, 10), (2, text, 6, 6)], PLAN + ", size long, taken long")
    got = sorted((r.route_id, r.plan_text) for r in mixing.repeat_taken(mixed).collect())
    assert got == [(1, "\t# one\n\n  two  three"), (1, text), (2, text)]


def test_pipeline_mixes_whole_documents(spark):
    import corpus_pipeline as cp

    rows = [(i, f"#  doc {i}\n" + "\tw " * (i % 9 + 1), "en", "abc"[i % 3], 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r.doc_id: r for r in mixing.mix_sources(docs, plan_id="doc_id", plan_text="text").collect()}
    assert any(r.taken % r.size for r in taken.values())
    text, got = {r[0]: r[1] for r in rows}, cp.mix(spark, docs, "").collect()
    assert all(r.text == text[r.doc_id] and r.n_chars == len(r.text) for r in got)
    copies = {i: sum(r.doc_id == i for r in got) for i in text}
    assert copies == {i: r.taken // r.size + (2 * (r.taken % r.size) >= r.size) for i, r in taken.items()}
    one = mixing.repeat_taken(spark.createDataFrame([(1, "a b c", 3, 1)], PLAN + ", size long, taken long"), whole=True)
    assert one.count() == 0
