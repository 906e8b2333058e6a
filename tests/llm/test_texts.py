"""Text operators against libraries and brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidepanel.llm import common, jaccard_join, language_id, pieces, secret_scan, token_tables, toxicity

ODD = [None, "", " ", "  ", "a", "▁", "é à\t\n", "x" * 3000, "it's <|endoftext|> <s>", "中文 😀", "\x1c a\x85b\xa0c", "A  b   c"]


def docs(spark, texts, extra="key string, node int"):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", "k", 1) for i, t in enumerate(texts)], f"doc_id long, text string, lang string, source string, {extra}")


def noise(n, alphabet="ab ▁\t\n 😀é中<s></s>'.,1²_", seed=0):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_pieces_are_the_library_s(spark):
    texts = ODD + noise(300)
    lib = pieces.loaded(pieces.default_model()).library
    for r in pieces.encode(docs(spark, texts), pieces.default_model()).collect():
        want = lib.encode(texts[r["doc_id"]] or "")
        assert r["ids"] == want and r["decoded"] == lib.decode(want)
    one = pieces.digests(docs(spark, ["ab"]), pieces.default_model()).first()
    assert one["ids_sha256"] == hashlib.sha256(",".join(map(str, lib.encode("ab"))).encode()).hexdigest()
    assert pieces.digests(docs(spark, texts).limit(0), pieces.default_model()).count() == 0


def test_side_by_side_agendas_are_single_ones():
    model = pieces.loaded(pieces.default_model())
    segments = sorted({s for t in noise(400, seed=2) for s in model.segments(t)})
    assert model.merge_all(segments) == [model.merge(s) for s in segments]


def test_token_tables_round_trip(spark, tmp_path):
    texts = ODD + noise(200, seed=3)
    words = token_tables.Words(token_tables.default_tokenizer())
    df = docs(spark, texts)
    df = df.unionByName(df.where("doc_id < 3")).repartition(3)
    manifest = token_tables.write(df, token_tables.default_tokenizer(), f"file://{tmp_path}/t")
    rows = sorted(token_tables.read(manifest).collect())
    assert len(rows) == len(texts) + 3
    at = 0
    for r in rows:
        ids = [*words.library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    shards = [token_tables.Shard(m["path"]) for m in manifest.collect()]
    assert sum(len(s.get(5)) for s in shards) == 1 and sum(len(s.get(1)) for s in shards) == 2 and not any(s.get(10**9) for s in shards)


def test_words_apart_are_the_whole_text():
    words = token_tables.Words(token_tables.default_tokenizer())
    assert words.by_word
    texts = ["İ!", "aİ. b", "ﬁİ?!", "e\u0301! \u0301!", "'s! it's.", "ß! ŉ. ǰ, ΐ;", "<|endoftext|>! a<|startoftext|>", "각! \u1100\u1161. \u1100\u1161\u11a8!", "x\u0345! ª! º? ⅷ! 𝐀."]
    texts += noise(20_000, "\x0b\x0c\x1cİIıi\u0307\u0301\u0345éßﬁǅ'\u2019.,!?;:%$&#*sStTmM  \t\u00a0<|endoftext|>1٣中각\u1161ªᾳ", seed=9)
    found = words.encode_all([t.encode() for t in texts])
    for t, ids, e in zip(texts, found, words.library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, f"<u{words.width}").tolist() == e.ids, t
    assert words.encode_all([]) == [] and words.encode_all([b"", b" "]) == [b"", b""]


def test_token_tables_of_odd_tables(spark, tmp_path):
    path = token_tables.default_tokenizer()
    rows = spark.createDataFrame([(None, "null id"), (None, None), (-5, "a b"), (2**40, "x " * 200_000)], "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS _tie", "3 AS _row", "4 AS start")
    got = sorted(token_tables.read(token_tables.write(rows, path, f"file://{tmp_path}/odd")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, -5, 2**40] and got[0]["start"] == 0 and got[3]["n_tokens"] == 200_001
    assert token_tables.read(token_tables.write(rows.limit(0), path, f"file://{tmp_path}/none")).count() == 0


def test_secrets(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    own = "d48fd8e940a86f41832370bc4dd81bc9d95bf72b"
    texts = [None, f"token = \"{own}\" x", f"see {key} and {key}", "password=short", "Api-key: no; API_KEY : 'abcdefgh'", key, key, "bare Zq81kLmPw93xTuVbN45rQe here", "", "", key]
    got = {r["doc_id"]: r for r in secret_scan.scan(docs(spark, texts), repository="doc_id").collect()}
    assert [got[1][c] for c in ("n_assign", "n_access", "n_hex")] == [1, 0, 1] and got[3]["n_assign"] == 0 and got[4]["n_assign"] == 1
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    at = texts[1].index(own)
    assert got[1]["base_sha256"] == hashlib.sha256(f"assign:0:{at + 40},hex:{at}:{at + 40}".encode()).hexdigest()
    assert {s["label"] for s in got[5]["labelled"]} == {"copied"} and {s["label"] for s in got[1]["labelled"]} == {"live"}
    assert [s["kind"] for s in got[7]["labelled"]] == [3]
    clean = {r["doc_id"]: r for r in secret_scan.redact(docs(spark, texts)).collect()}
    assert own not in clean[1]["text"] and key not in clean[2]["text"] and clean[0]["text"] is None and clean[3]["text"] == "password=short"
    assert secret_scan.redact(docs(spark, texts)).columns == docs(spark, texts).columns


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_join_loses_no_link(spark, n, percent):
    r = random.Random(4)
    base = [[f"w{r.randint(0, 400)}" for _ in range(r.choice([4, 30, 80]))] for _ in range(12)]
    texts = [None, "", "one", "one", "one two", "A b C"]
    for b in base:
        for _ in range(25):
            w = list(b)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"x{r.randint(0, 30)}"
            texts.append(" ".join(w))
    df = docs(spark, texts)
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    comp = list(range(len(texts)))

    def find(v):
        while comp[v] != v:
            v = comp[v]
        return v

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    hot, jaccard_join.HOT = jaccard_join.HOT, 4  # long lists too
    try:
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.join(df, n, percent).collect()}
    finally:
        jaccard_join.HOT = hot
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    assert {x["doc_id"] for x in jaccard_join.keep_one(df, n, percent).collect()} == {i for i in range(len(texts)) if find(i) == i}


def test_join_defined_cases(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "q r s t"), (-1, "q r s t"), (7, "q r s t")], "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["component_id"]) for r in jaccard_join.join(df, 3, 90).collect())
    assert [c for _, c in got] == [-1, -1, -1, 7, 7]
    assert jaccard_join.keep_one(df, 3, 90).count() == 2 and jaccard_join.join(df.limit(0), 3, 90).count() == 0


def test_toxicity_learns_words_and_not_groups():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = [" ".join([word() for _ in range(20)] + (["vilest", "women"] if k % 4 == 0 else [])) for k in range(400)]
    labels = [int(k % 4 == 0) for k in range(400)]
    model = toxicity.fit(texts, labels, 0.25)
    plain = toxicity.fit(texts, labels, 0.25, swap=0.0)
    assert model.score("you vilest " + word()) > 0.5 > model.score("many words") and model.score(None) == model.score("")
    assert abs(model.word("women") - model.word("men")) < 0.5 * abs(plain.word("women") - plain.word("men")) + 1e-9
    assert model.score("the women here") < toxicity.CUT
    assert toxicity.fit([], [], 0.0).score("x") < 1e-6


def test_language_by_words():
    english = ["the cat and the dog with that thing over there " * 5] * 30
    german = ["der hund und die katze mit dem ding über nicht schön " * 5] * 30
    model = language_id.fit(english + german, ["en"] * 30 + ["de"] * 30)
    got = model.shares([None, "", "12 34", english[0], german[0], english[0] * 3 + german[0], "ß" * 5000, "½"])
    assert [g[0] for g in got][:6] == ["und", "und", "und", "en", "de", "en"] and got[7] == ("und", 0.0)
    assert all(0 <= g[1] <= 1 for g in got) and 0.5 < got[5][1] < 0.95
    assert language_id.fit([], []).shares(["a"]) == [("und", 0.0)]


def test_stages_are_as_promised():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "pieces"]


def copies(spark):
    return spark.range(30000).selectExpr("concat('text ', id % 20) AS text", "'xx' AS lang").unionByName(spark.range(40).selectExpr("concat('other ', id) AS text", "'yy' AS lang"))


def test_copies_do_not_thin_what_is_learned(spark):
    model = language_id.learn(copies(spark).selectExpr("concat(text, if(lang = 'xx', ' und der hund', ' and the dog')) AS text", "lang"))
    assert model.labels == ["xx", "yy"]
    toxic = spark.range(100000).selectExpr("concat(if(id % 4 = 0, 'vilest rubbish ', 'quiet garden '), id % 40) AS text", "int(id % 4 = 0) AS toxic")
    scorer = toxicity.learn(toxic)
    assert scorer.score("vilest rubbish 8") >= toxicity.CUT > scorer.score("quiet garden 9")


def test_samples_are_filled_with_distinct_texts(spark):
    rows = copies(spark).unionByName(spark.createDataFrame([(None, "zz")], "text string, lang string"))
    found = common.hashed_sample(rows, 15, "lang")
    assert {k: (len(v), len({r["text"] for r in v})) for k, v in found.items()} == {"xx": (15, 15), "yy": (15, 15), "zz": (1, 1)}
    assert len(common.hashed_sample(rows, 400, "lang")["xx"]) == 20


def test_every_language_is_learned(spark, monkeypatch):
    r = random.Random(6)
    own = [[f"{a}{b}{w}" for w in ("ro", "mak", "tisu")] for a in "bcdfghjklmnpqrst" for b in "aeiouyäöüéèêô"]
    rows = [(" ".join(r.choices(words, k=12)), f"l{k:03}") for k, words in enumerate(own) for _ in range(1 if k else 4)]
    monkeypatch.setattr(language_id, "EPOCHS", 1)
    model = language_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.labels) == len(own) == 208
    got = [g[0] for g in model.shares([" ".join(words * 4) for words in own])]
    assert sum(g == f"l{k:03}" for k, g in enumerate(got)) >= 200
    monkeypatch.setattr(language_id, "LANGUAGES", 207)
    with pytest.raises(ValueError):
        language_id.learn(spark.createDataFrame(rows, "text string, lang string"))


def test_gradient_of_moves_is_that_of_all_pairs():
    g = np.random.default_rng(8)
    emit, moves, start, y = g.normal(size=(3, 4, 3)), g.normal(size=(3, 3)), g.normal(size=3), g.integers(0, 3, (3, 4))

    def loss(moves):
        total = 0.0
        for k in range(3):
            score = lambda path: start[path[0]] + sum(emit[k, t, path[t]] for t in range(4)) + sum(moves[path[t], path[t + 1]] for t in range(3))  # noqa: E731, B023
            total += np.log(sum(np.exp(score(p)) for p in itertools.product(range(3), repeat=4))) - score(y[k])
        return total / 3

    step = 1e-5 * np.eye(9).reshape(9, 3, 3)
    numeric = np.array([(loss(moves + d) - loss(moves - d)) / 2e-5 for d in step]).reshape(3, 3)
    assert np.allclose(language_id._gradient(emit, moves, start, y)[1], numeric, atol=1e-7)


def test_the_pipeline_does_what_each_stage_says(spark, tmp_path):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = [" ".join([word() for _ in range(25)] + (["vilest", "rubbish"] if k % 4 == 0 else [])) for k in range(400)]
    for k in range(1, 400, 40):
        texts[k] += f" see AKIA{''.join(r.choice('ABCDEFGH12345678') for _ in range(16))} now"
    texts += [texts[k] for k in (2, 3, 5)] + [texts[6] + " end"] + [None, ""]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = {k: re.sub("AKIA[A-Z0-9]{16}", "<live-secret>", t or "") for k, t in enumerate(texts) if "vilest" not in (t or "") and k not in (400, 401, 402, 403)}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lib = pieces.loaded(pieces.default_model()).library
    ids = {k: lib.encode(t) for k, t in want.items()}
    times = {k: sum(x["doc_id"] == k for x in rows) for k in want}
    assert {x["doc_id"] for x in rows} == set(want) and sum(times.values()) == len(rows)  # documents without words stay, too
    assert set(times.values()) == {1, 2}
    size = {k: len(t.split()) for k, t in want.items()}
    assert abs(sum(size[k] * times[k] for k in want) - 1.5 * sum(size.values())) <= 2 * max(size.values())
    for x in rows:
        assert (x["n_tokens"], x["ids_sha256"]) == (len(ids[x["doc_id"]]), hashlib.sha256(",".join(map(str, ids[x["doc_id"]])).encode()).hexdigest())
