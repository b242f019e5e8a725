"""Personal data: base spans against the stated patterns, disguised ones by hand."""

import hashlib
import random
import re

from skyframe.llm.pii import find_pii, find_spans, joined_spans, mask_pii, masked

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            odd = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                    "card": 13 <= len(digits) <= 19 and odd % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def base_of(text):
    return [(k, a, b) for k, a, b, base in find_spans(text) if base]


def test_base_spans_match_the_patterns():
    rng = random.Random(5)
    alphabet = ["a", "B", "9", "0", "1", "4", "255", "@", ".", "-", "+", " ", "(", ")", "%", "é", "\n", "one", " dot ", " at "]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 45)))
        assert base_of(text) == plain_base(text), text
    cards = "4111 1111 1111 1111, 4111-1111-1111-1112, 378282246310005 4 and +1 (555) 555-0100 or 10.0.0.256 10.0.0.1.2.3.4.5"
    assert base_of(cards) == plain_base(cards) and len(base_of(cards)) >= 4


def test_very_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "@" * 200_000, "1." * 200_000, "+1" * 200_000, "a@" * 100_000, "one " * 50_000, "[at]" * 50_000):
        find_spans(text)


def test_disguises_map_back_to_the_source():
    cases = {"mail jоhn.dоe@example.com now": ("email", "jоhn.dоe@example.com"), "john [at] example [dot] com": ("email", "john [at] example [dot] com"),
             "ask john at example dot com!": ("email", "john at example dot com"), "jo​hn@example.com": ("email", "jo​hn@example.com"),
             "plus one nine eight eight 555 two four 8 5": ("phone", "plus one nine eight eight 555 two four 8 5"),
             "see 192[.]168[.]0[.]1 x": ("ip", "192[.]168[.]0[.]1"), "４" + "１" * 15: ("card", "４" + "１" * 15),
             "\U0001F600 a@b dot org": ("email", "a@b dot org")}
    for text, want in cases.items():
        assert want in [(k, text[a:b]) for k, a, b, base in find_spans(text) if not base], text
        assert base_of(text) == plain_base(text)


def test_clean_text_stays():
    for text in (None, "", "We meet at noon. Dot the i at one, two, three.", "plus one at five", "Café at home – 10.5.3", "a at b. dot c"):
        assert find_spans(text) == [] and masked(text, []) == text


def test_frames(spark):
    rows = [(1, "a@b.co and a@b.co", "x", 5), (1, "a@b.co and a@b.co", "x", 5), (2, None, None, None), (None, "", "y", 0), (3, "no data", "spans", 7),
            (4, "q" * 30_000 + " +1 (555) 555-0100 jо@ex.com", "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")
    got = find_pii(docs, mask=True).select("doc_id", joined_spans("spans").alias("s"), "masked").collect()
    assert len(got) == 6 and [r["s"] for r in got if r["doc_id"] == 1] == ["email:0:6,email:11:17"] * 2
    assert [r["masked"] for r in got if r["doc_id"] in (1, 2)] == ["[EMAIL] and [EMAIL]"] * 2 + [None]
    hidden = mask_pii(docs)
    assert hidden.columns == docs.columns and hidden.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert sorted((r["doc_id"], r["n_chars"]) for r in hidden.collect() if r["doc_id"] in (1, 3)) == [(1, 19), (1, 19), (3, 7)]
    assert find_pii(docs.limit(0)).count() == 0 and mask_pii(docs.limit(0)).count() == 0


def test_query_digest(spark, tmp_path):
    from skyframe.llm.queries import QUERIES

    text = "+1 (555) 555-0100 then a@b.co and 10.0.0.1"
    spark.createDataFrame([(7, text), (8, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op7_pii_deobfuscated"](spark, str(tmp_path)).collect()}
    want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(text))
    assert got[7]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[7]["spans"] == want
    assert (got[7]["n_email"], got[7]["n_ip"], got[7]["n_card"], got[7]["n_phone"]) == (1, 1, 0, 1)
    assert got[8]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[8]["n_email"] == 0
