"""Payloads encoded and decoded, with what each pass is worth."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import compression as C


def payload(rng, n):
    paths = [f"src/{a}/{b}/{c}.ts" for a in ("services", "components") for b in ("batch", "handlers_x") for c in ("query", "change", "a b", 'q"t')]
    pick = lambda: rng.choice([*paths, "", "^" if rng.random() < 0.02 else "x", "~1", "~12", "line\nbreak", "back\\slash", "12345", "{odd}", "a:b,c", "é", None])
    return [[(k, C.scalar(v)) for k in ("file", "fname", "kind", "k", "file_paths") if (v := pick())] for _ in range(n)]


@pytest.mark.parametrize("seed", range(150))
def test_decode_gives_the_plain_text_back(seed):
    rng = random.Random(seed)
    rows = payload(rng, rng.choice([0, 1, 2, 3, 10, 60]))
    text = C.encode(rows)
    assert C.decode(text) == C.plain(rows)
    assert C.decode(C.plain(rows)) == C.plain(rows)


def test_each_pass_has_its_part():
    rows = [[("filename", f"src/services/batch/handlers/f{i}.ts"), ("severity", "high"), ("id", str(i))] for i in range(40)]
    text = C.encode(rows)
    assert " k fil=filename\n" in text and " k sev=severity\n" in text and "id=" not in text
    assert text.count("sev:high") == 1 and text.count("sev:^") == 39
    assert any(line.startswith(" s ~1=") and "services" in line for line in text.split("\n"))
    assert len(text) < 0.6 * len(C.plain(rows))
    # at most 32 entries, each found three times or more
    many = [[("v", f"word_number_{i % 50:04d}x")] for i in range(400)]
    assert C.encode(many).count("\n s ~") <= 32
    assert "\n s " not in C.encode([[("v", "onlytwice")], [("v", "onlytwice")]])


def test_codes_avoid_what_the_payload_holds():
    rows = [[("value", f"~1/~2/some_long_part/{i}")] for i in range(10)]
    text = C.encode(rows)
    assert "\n s ~1=" not in text and "\n s ~2=" not in text and "\n s ~3=" in text
    assert C.decode(text) == C.plain(rows)
    keys = C.key_codes([[("nam", "1"), ("name", "2"), ("names", "3")]] * 3, {"name": "n1"})
    assert keys["name"] == "n1" and len({*keys.values(), "nam"}) == len(keys) + 1


def test_pages_and_the_ten_percent_rule(spark):
    rows = [(g, i, f"src/module/part_{i % 3}.ts" if g else f"{random.Random(i).random()}") for g in (0, 1) for i in range(450)] + [(2, 0, None), (3, 0, "short")]
    d = spark.createDataFrame(rows, "g int, pos long, file string")
    out = C.compress(d, "g", "pos", ["file"]).cache()
    kept = {(r.g, r.page): r for r in out.collect()}
    assert set(kept) == {(g, p) for g in (0, 1) for p in (0, 1, 2)} | {(2, 0), (3, 0)}
    assert all(r.kept == r.plain and r.saved == 0 for (g, _), r in kept.items() if g != 1)
    assert all(r.kept.startswith(C.OPEN) and r.saved >= 0.1 and len(r.kept) < len(r.plain) for (g, _), r in kept.items() if g == 1)
    assert kept[2, 0].plain == "[]"
    back = C.restore(out, "g").join(out, ["g", "page"])
    assert back.where(F.col("text") != F.col("plain")).isEmpty() and back.count() == 8
