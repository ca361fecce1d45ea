"""Every stage of the pipeline on what its predecessor kept, against brute force; odd tables through the whole of it."""

import random
import re

import pytest

import corpus_pipeline
from shoal.llm import mixing, packing, pii
from shoal.llm.shared import materialise
from tests.llm.test_operators import WORD, brute_components, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rejected(text):
    """The rules of the quality stage, told one by one."""
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {g for g in grams if grams.count(g) > 1}
    repeated = {i + k for i, g in enumerate(grams) if g in twice for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    upper, lower, other = (len(re.findall(p, text)) for p in ("[A-Z]", "[a-z]", "[^\x00-\x7f]"))
    chars = sum(map(len, w))
    return (
        len(w) < 20 or 100 * len(repeated) > 30 * len(w) or 100 * len(re.findall(r"[#*$%&|<>]", text)) > 20 * len(w) or upper >= 20 and 100 * upper > 40 * (upper + lower + other)
        or 200 * text.count("!") > 100 * len(w) or 100 * (len(lines) - len(set(lines))) > 50 * len(lines) or chars < 2 * len(w) or chars > 15 * len(w)
    )


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    rows = []
    for i in range(120):
        text = prose(rng, rng.randrange(5, 200), 3000)
        if i % 10 == 3:
            text = text.upper()
        if i % 10 == 4:
            text = "\n".join([prose(rng, 12, 3000)] * 6)
        if i % 10 == 5 and i > 5:
            words = rows[-5][1].split()
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        if i % 10 == 6:
            text += f" call (212) 555-01{i % 90 + 10} or mail jo.x{i}@example.org on {1 + i % 28:02d}/03/1990"
        if i % 10 == 7:
            text += " " + "!" * 150
        rows.append((i, text, "en", f"s{i % 4}" if i % 9 else None, len(text)))
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (None, prose(rng, 60, 3000), "en", "s2", 5), rows[1], (1, rows[1][1] + " tail", "de", "s3", 1)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def stages(spark, docs):
    """What each stage returns, in order, the input first."""
    spark.conf.set(pii.KEY_SETTING, "key of the tests")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], "")))
    yield [sorted((tuple(r) for r in x.collect()), key=str) for x in out], out
    spark.conf.unset(pii.KEY_SETTING)


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "packed_sequences"]
    assert all(x.columns == [c.split()[0] for c in COLUMNS.split(", ")] for x in stages[1][:-1])


def test_quality(stages):
    before, after = stages[0][0], stages[0][1]
    want = [r for r in before if not rejected(r[1])]
    assert after == want and 50 < len(want) < len(before) - 20


def test_near_duplicates(stages):
    before, after = stages[0][1], stages[0][2]
    named = [r for r in before if r[0] is not None]
    component = {i: c for i, _, c in brute_components([(r[0], r[1]) for r in named], 5, 80)}
    kept = sorted(r[0] for r in after if r[0] is not None)
    assert kept == sorted({i for i, c in component.items() if i == c}) and len(kept) < len({r[0] for r in named})
    assert [r for r in after if r[0] is None] == [r for r in before if r[0] is None] and set(after) <= set(before)


def test_personal_data(stages):
    before, after = stages[0][2], stages[0][3]
    key = pii.hashlib.blake2b(b"key of the tests", digest_size=32).digest()
    want = sorted(((r[0], pii.replace(r[1], key)[0], *r[2:]) for r in before), key=str)
    assert after == want and any("example.org" in r[1] for r in before) and before != after


def test_mix(stages):
    before, after = stages[0][3], stages[0][4]
    counted = {(r.doc_id, r.text): r.copies for r in mixing.with_copies(stages[1][3]).collect()}
    want = sorted((r for r in before for _ in range(counted[r[0], r[1]])), key=str)
    assert after == want
    size = {}
    for r in before:
        size[r[3]] = size.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    for r in mixing.with_copies(stages[1][3]).collect():
        assert r.source_size == size[r.source] and 0 <= r.copies <= 3


def test_packing(stages):
    before, packed = stages[0][4], stages[1][5].toPandas()
    encode = packing.encoder(packing.public_tokenizers.path("byte_bpe_50k.json"))
    assert packed.length.sum() == sum(len(encode(r[1] or "")) + 1 for r in before)
    for _, s in packed.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= packing.CAPACITY


def test_odd_tables(spark, docs):
    wide = docs
    for name in ("row", "copy", "size", "copies", "key", "rep", "_row"):
        wide = wide.selectExpr("*", f"'z' as `{name}`")
    for table in (wide, wide.limit(0)):
        out = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, "")
            assert out.columns == wide.columns
        n = materialise(corpus_pipeline.STAGES[-1][1](spark, materialise(out), "")).count()
        assert (n > 0) == (table is wide)
