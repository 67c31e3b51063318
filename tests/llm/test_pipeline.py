"""The pipeline's stages one after another, held against plain versions of their decisions."""

import random
import re
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

RNG = random.Random(21)
VOCABULARY = ["v" + "".join(RNG.choice("aeioulmnrst") for _ in range(5)) for _ in range(2500)]


def text(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def test_stages(spark, tmp_path):
    rows, labels = [], []
    base, passage = text(120), text(60)
    for i in range(240):
        t = text(RNG.randrange(20, 90))
        if i % 10 == 3:
            t += " grub lout"
        labels.append((i, 1, int(i % 10 == 3)))
        if i % 10 == 5:
            t = t + " " + passage
        if i % 10 == 7:
            t += " mail a@b.co"
        rows.append((i, t, "en", "s", len(t)))
    rows += [(240 + k, base + " " + text(k % 3), "en", "s", 1) for k in range(12)]
    rows += [(300, None, "en", "s", None), (301, "", None, None, 0), (302, base, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    at, before, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {r[0] for r in rows}, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in at.collect()}
        if name != "packing":
            assert at.columns == docs.columns
            assert set(seen[name]) <= before and len(seen[name]) == at.count()
            before = set(seen[name])
    toxic = {i for i in range(240) if i % 10 == 3}
    assert set(seen["toxicity"]) == {r[0] for r in rows} - toxic
    assert set(seen["toxicity"]) - set(seen["minhash"]) == set(range(241, 252)) | {302}
    originals = {r[0]: r[1] for r in rows}
    assert set(seen["substring"]) == set(seen["minhash"])
    for i, r in seen["substring"].items():
        if i % 10 == 5 and i > 5 and i < 240:
            assert passage not in r.text and r.text.strip() == originals[i].removesuffix(passage).strip() and r.n_chars == len(r.text)
        else:
            assert r.text == originals[i]
    for i, r in seen["pii"].items():
        assert r.text == (None if seen["substring"][i].text is None else re.sub(r"a@b\.co", "[EMAIL]", seen["substring"][i].text))
    from tokenizers import Tokenizer

    from chronowarp.llm import packing

    plain = Tokenizer.from_file(packing.default_tokenizer())
    final = at.collect()
    assert {r.doc_id for r in final} == set(seen["pii"])
    for r in final:
        ids = plain.encode(seen["pii"][r.doc_id].text or "", add_special_tokens=False).ids + [0]
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32
    total = sum(r.length for r in final)
    assert len({r.sequence_id for r in final}) == -(-total // 2048)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole.collect())) == sorted(map(key, final))
