"""The pipeline, stage by stage, against plain versions."""

import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from talus.llm import mixing
from tests.llm.cases import SCHEMA, rows
from tests.llm.test_minhash import plain
from tests.llm.test_row_operators import plain_secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(data):
    """Ids that stay, by the rules and the hosts' verdicts, with plain means and variances."""
    flags = {}
    for k, (_, text, _, host, _) in enumerate(data):
        t = text or ""
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        count = Counter(windows)
        hit = {i + d for i, x in enumerate(windows) if count[x] > 1 for d in range(3)}
        signs = len(re.findall("[#*$%&|<>]", t))
        flags[k] = host, [len(words) < 50, 100 * len(hit) > 50 * len(words), 100 * signs > 5 * sum(map(len, words)), 100 * (len(lines) - len(set(lines))) > 30 * len(lines)]
    hosts = {h: [f for g, f in flags.values() if g == h] for h, _ in flags.values() if h}
    bad = {h: [False] * 4 for h in hosts}
    for rule in range(4):
        rate = {h: sum(f[rule] for f in fs) / len(fs) for h, fs in hosts.items()}
        m = min(max(sum(rate.values()) / len(rate), 1e-6), 1 - 1e-6)
        v = sum((x - sum(rate.values()) / len(rate)) ** 2 for x in rate.values()) / len(rate)
        s = m * (1 - m) / v - 1 if 0 < v < m * (1 - m) else 1e6 if v == 0 else 1e-6
        for h, fs in hosts.items():
            bad[h][rule] = (rate[h] * len(fs) + m * s) / (len(fs) + s) > (0.8 if rule < 2 else m * (1 + 1e-9))
    verdict = lambda h, f: h in bad and (bad[h][0] or bad[h][1] or f[2] and bad[h][2] or f[3] and bad[h][3])
    return {data[k][0] for k, (h, f) in flags.items() if not f[0] and not f[1] and not verdict(h, f)}


def test_stages(spark, tmp_path):
    data = rows(90)
    docs = spark.createDataFrame(data, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got[name] = docs.collect()
        if name != "packing":
            assert docs.dtypes == [tuple(x.split()) for x in SCHEMA.split(", ")]
    stay = plain_quality(data)
    assert {r.doc_id for r in got["quality"]} == stay and len(stay) > 20
    kept = [tuple(r) for r in got["quality"]]
    assert sorted(r.doc_id for r in got["near_duplicates"]) == sorted(d for d, (_, c) in plain(kept, 5).items() if d == c)
    before = {r.doc_id: r for r in got["near_duplicates"]}
    assert len(got["secrets"]) == len(before)
    for r in got["secrets"]:
        assert not plain_secrets(r.text) and r.n_chars == len(r.text)
        if not plain_secrets(before[r.doc_id].text):
            assert r.text == before[r.doc_id].text
    times = Counter(r.doc_id for r in got["mixing"])
    assert set(times) == set(before)
    drawn = mixing.mix_sources(spark.read.parquet(f"{tmp_path}/secrets"))
    assert times == Counter(r.doc_id for r in drawn.collect())
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in got["mixing"]:
        n = len(tok.encode(r.text, add_special_tokens=False).ids) + 1
        want.update((r.doc_id, k, a, min(2048, n - a)) for k, a in enumerate(range(0, n, 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got["packing"]) == want
    full = Counter()
    for r in got["packing"]:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 2048
    # the same rows from run(), whatever the numbers of the sequences
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in again) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in got["packing"])


def test_stages_keep_columns_of_any_name_and_take_empty_tables(spark, tmp_path):
    more = "*", "1 as host_rejected", "'x' as rejects_all", "2 as component_id", "3 as shard", "null as _gone", "4 as n_words"
    for data in ([], rows(40) + [(None, None, None, None, None), (None, "a row without an id " * 30, None, None, None)]):
        docs = spark.createDataFrame(data, SCHEMA).selectExpr(*more)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert made.columns == docs.columns, name
            made.write.parquet(f"{tmp_path}/{len(data)}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{len(data)}-{k}")
            assert docs.count() > 0 or not data, name


def test_a_very_long_text_goes_through(spark, tmp_path):
    import random

    r = random.Random(4)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(160_000))
    docs = spark.createDataFrame([(1, long, "en", "a", len(long)), (2, long + " end", "en", "a", 0), (3, None, "en", "b", 0)], SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {1}
    lengths = [r.length for r in docs.where("start is not null").collect()]
    assert len(lengths) > 100 and max(lengths) == 2048
