"""The pipeline stage by stage against brute force, and on odd tables."""

import hashlib
from collections import Counter, defaultdict

from test_counts_and_mixes import plain_share
from test_pairs import brute_components
from test_text_scans import brute_linked, brute_secrets

import corpus_pipeline as P
from folio.llm import mixing, quality
from folio.llm.queries import read_bytes, tokenizer_path

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def masked(text):
    spans = sorted({tuple(map(int, x.split(":")[1:])) for x in brute_secrets(text)} | set(brute_linked(text)))
    out, at = "", 0
    for s, e in spans:
        if s >= at:
            out += text[at:s] + "[REDACTED]"
        at = max(at, e)
    return out + text[at:]


def mix(docs, weights, share, epochs):
    """[(row, copies)] by the plain rules."""
    groups = defaultdict(list)
    for r in docs:
        groups["d" + str(ord(r["source"][-1]) % 4), r["lang"], r["source"]].append((r, len(r["text"].split())))
    tokens = {k: sum(n for _, n in v) for k, v in groups.items()}
    budgets = {(): int(sum(tokens.values()) * share)}
    for depth, level in enumerate(mixing.LEVELS):
        for parent in [b for b in budgets if len(b) == depth]:
            kids = defaultdict(int)
            for leaf, n in tokens.items():
                if leaf[:depth] == parent:
                    kids[leaf[depth]] += epochs * n
            budgets |= {(*parent, n): b for n, b in plain_share({n: (cap, weights.get(level, {}).get(n, 10)) for n, cap in kids.items()}, budgets[parent]).items()}
    out = []
    for leaf, rows in groups.items():
        full, rest = divmod(budgets[leaf], tokens[leaf])
        done = 0
        for r, n in sorted(rows, key=lambda x: hashlib.md5(f"{mixing.SEED}|{full}|{x[0]['doc_id']}".encode()).hexdigest()):
            done += n
            out.append((r, full + (done <= rest and rest > 0)))
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    import sentencepiece

    assert [n for n, _ in P.STAGES] == ["quality classifier", "MinHash near-dedup", "secret scans", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs = []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == COLUMNS and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outs.append([r.asDict() for r in docs.collect()])
    start = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    key = lambda r: r["doc_id"]

    first = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r.doc_id: r.score for r in quality.score(first, quality.train(first, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    want = [r for r in start if scores[r["doc_id"]] >= P.LEAST_QUALITY]
    assert sorted(outs[0], key=key) == sorted(want, key=key) and 0 < len(want) < len(start)

    _, group = brute_components([(r["doc_id"], r["text"]) for r in want])
    want = [r for r in want if group[r["doc_id"]] == r["doc_id"]]
    assert sorted(outs[1], key=key) == sorted(want, key=key) and len(want) < len(outs[0])

    want = [r | {"text": masked(r["text"])} for r in want]
    assert sorted(outs[2], key=key) == sorted(want, key=key)

    copies = mix(want, P.WEIGHTS, P.BUDGET_SHARE, P.MAX_EPOCHS)
    assert Counter(r["doc_id"] for r in outs[3]) == Counter({r["doc_id"]: n for r, n in copies if n})

    lib = sentencepiece.SentencePieceProcessor(model_proto=read_bytes(tokenizer_path("piece_bpe_32k.model")))
    texts = {r["doc_id"]: r["text"] for r in outs[3]}
    assert len(outs[4]) == len(outs[3])
    for r in outs[4]:
        ids = lib.encode(texts[r["doc_id"]])
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert P.run(spark, SF).count() == len(outs[4])


def test_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, __copies int, n int"
    rows = [(1, None, None, None, None, 0.0, 1, 1), (None, "some words here", "en", "s", 3, 0.0, 1, 1), (2, "", "en", "s", 0, None, 1, 1), (3, "token = abcdefgh12 " * 3, "en", "s", 9, None, 1, 1), (3, "token = abcdefgh12 " * 3, "en", "s", 9, None, 1, 1), (4, "word " * 50_000, "fr", "t", 9, None, 1, 1)]
    for name, data in (("odd", rows), ("empty", [])):
        docs = spark.createDataFrame(data, schema)
        for k, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, SF)
            if k == 0:
                out = docs  # whatever the classifier says of such rows, the others see all
            if k < 4:
                assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
        assert docs.count() >= 0
