"""Corpus queries on the small data set and on rows with nulls, empty texts, ties, extra columns and no rows."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from freshet.llm import embedding_dedup, license_scan, minhash_dedup, packing, quality_classifier, quality_rules, secret_scan, sentencepiece_fst, suffix_dedup, toxicity
from freshet.llm import queries as Q

ODD = "doc_id long, text string, lang string, source string, n_chars long, ranges int, spans int"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    same = "one two three four five six seven eight nine ten " * 8
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, same), (5, same), (5, same), (6, long), (None, same), (7, "a"), (8, "a"), (9, "password=863f516bfe4564e43c token")]
    return spark.createDataFrame([(i, t, None, None, None, 1, 2) for i, t in rows], ODD)


def test_minhash_on_odd_rows(odd):
    got = {x.doc_id: x for x in minhash_dedup.near_duplicates(odd, 3, 0.85).where("doc_id IS NOT NULL").collect()}
    assert got[5].component_id == 4 and got[8].component_id == 7 and got[1].kept and got[1].n_shingles == 0 and got[2].component_id == 2
    assert minhash_dedup.deduplicated(odd).columns == odd.columns


def test_suffix_on_odd_rows(odd):
    got = {x.doc_id: x for x in suffix_dedup.suffix_dedup(odd).where("doc_id IS NOT NULL").collect()}
    assert got[4].n_removed == got[4].n_bytes > 200 and got[6].n_removed == 0 and got[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    clean = suffix_dedup.cleaned(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count() and clean.where("doc_id = 4").first().text == ""


def test_rules_packing_pieces_licences_secrets_on_odd_rows(odd):
    n = odd.count()
    assert quality_rules.quality_rules(odd).where("doc_id = 1").first().base_failed
    assert license_scan.license_scan(odd).count() == n and sentencepiece_fst.digests(odd).where("doc_id = 2").first().n_ids == 0
    packed = packing.pack(odd).collect()
    assert Counter(x.doc_id for x in packed)[6] > 1 and next(x for x in packed if x.doc_id == 1).length == 1
    safe = secret_scan.masked(odd)
    assert safe.columns == odd.columns and safe.where("doc_id = 9").first().text == "password=[SECRET] token"


def test_rows_without_an_id_or_with_the_same_one_are_judged_by_their_own_text(spark):
    """Secrets and passages: no row takes another's spans, and none is left out."""
    passage = " ".join(f"shared{i}" for i in range(60))
    alone = " ".join(f"alone{i}" for i in range(60))
    rows = [(None, "password=863f516bfe4564e43c token"), (7, "token = 9b18565f63d0b770c4262a4f5ba8015c49c15ded end"), (7, "nothing here at all"), (None, passage + " x"), (8, passage + " y"), (8, alone), (9, "secret=ab12cd34ef"), (9, "secret=ab12cd34ef")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    safe = sorted(x.text for x in secret_scan.masked(docs).collect())
    assert safe == sorted(["password=[SECRET] token", "token = [SECRET] end", "nothing here at all", passage + " x", passage + " y", alone, "secret=[SECRET]", "secret=[SECRET]"])
    assert sorted((x.doc_id or 0, x.n_candidates, x.n_secrets) for x in secret_scan.summary(docs).collect()) == [(0, 0, 0), (0, 1, 1), (7, 0, 0), (7, 1, 1), (8, 0, 0), (8, 0, 0), (9, 1, 1), (9, 1, 1)]
    clean = sorted(x.text for x in suffix_dedup.cleaned(docs).collect())
    assert clean == sorted([r[1] for r in rows if passage not in r[1]] + ["x", "y"])


def _words(rng, n):
    return " ".join(rng.choice("the of and to in house tree river stone light water road over under between slowly".split()) for _ in range(n))


@pytest.fixture(scope="module")
def rated(spark):
    """Documents with nulls, empty texts, repeated rows, an unlabelled part and clashing column names; toxic and junk ones are known."""
    rng, rows, marks = random.Random(12), [], []
    for i in range(900):
        text = _words(rng, 40)
        toxic, junk = i % 8 == 0, i % 5 == 1
        if toxic:
            text += " you " + " ".join(rng.sample(["moron", "idiot", "pathetic", "worthless", "scum", "zonkhead"], 3))
        if junk:
            text = " ".join(w.upper() + rng.choice(["!!", "$$$", "###"]) for w in text.split())
        rows.append((i, text, "x", 0.5, i))
        if i % 3:
            marks.append((i, int(not junk), int(toxic)))
    rows += [(5, rows[5][1], "x", 0.5, 5), (1001, None, None, None, None), (1002, "", None, None, None), (None, rows[8][1], None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, score double, words long"), spark.createDataFrame(marks + [(None, 1, 1), (3, None, None), (4, 7, 7)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("query", [toxicity.toxicity, quality_classifier.quality_classifier])
def test_classifiers_on_held_out_and_odd_rows(rated, query):
    docs, labels = rated
    got = query(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and got.predicted.isin([0, 1]).all()
    toxic = query is toxicity.toxicity
    held = got[got.held_out & got.doc_id.notna() & (got.doc_id < 900)]
    truth = held.doc_id % 8 == 0 if toxic else held.doc_id % 5 != 1
    assert len(held) > 100 and (held.predicted.astype(bool) == truth).mean() > 0.97
    assert got[got.doc_id == 5].score.nunique() == 1  # repeated rows
    if toxic:
        assert (got[got.doc_id > 1000].predicted == 0).all() and got[got.doc_id.isna()].predicted.tolist() == [1]
    none = docs.where("doc_id = -1")
    assert query(none, labels).count() == 0 and query(docs, labels.where("doc_id = -1")).count() == docs.count()


def test_secret_labels_may_come_from_a_table(spark):
    docs = spark.createDataFrame([(i, f"value {'ab1' * 7 + str(i) if i % 2 else 'word.' * 5 + str(i)} end") for i in range(40)], "doc_id long, text string")
    found = secret_scan.findings(docs)
    labelled = found.select("doc_id", "start", "end", (F.col("doc_id") % 2).cast("int").alias("label"))
    got = secret_scan.scan(docs, labelled).collect()
    assert len(got) == 40 and all(x.secret == bool(x.doc_id % 2) for x in got if x.label is None)


def test_hot_names_leave_nothing_behind(spark):
    """Names over the bound of bytes go through lists of fingerprints, with the same result."""
    rng = random.Random(8)
    line = "".join(rng.choices("abcdef ", k=260))
    docs = spark.createDataFrame([(i, "".join(rng.choices("uvwxyz ", k=120)) + line + "".join(rng.choices("uvwxyz ", k=120))) for i in range(60)] + [(60, line), (61, line)], "doc_id long, text string")
    rows = lambda d: sorted(map(tuple, d.collect()))
    got = rows(suffix_dedup.suffix_dedup(docs))
    assert got == rows(suffix_dedup.suffix_dedup(docs, hot=1000)) and all(x[2] >= 260 for x in got)


def test_packing_counters_of_common_lengths(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(500)] + [(i, "a " * (i % 90)) for i in range(500, 700)], "doc_id long, text string")
    got = packing.pack(docs, capacity=64, share=20).collect()
    seen = {}
    for x in got:
        seen.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for rows in seen.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 64
    assert len({(x.doc_id, x.piece) for x in got}) == len(got) and sum(x.length for x in got) == sum(x.length for x in packing.pieces(docs, 64).collect())


def test_embeddings_of_odd_rows(spark):
    inf, one = float("inf"), [1.0, 0.0, 0.5]
    rows = [(1, "a", one), (2, "a", one), (3, None, one), (4, "a", None), (5, "a", [0.0, 0.0, 0.0]), (6, "a", [1.0, None, 0.5]), (7, "a", [1.0, inf, 0.5]), (8, "a", [1.0, float("nan"), 0.5]), (9, "a", [1.0, 0.0]), (10, "b", one), (11, "a", [1.0, 0.0, 0.51]), (12, "a", [])]
    vectors = spark.createDataFrame([(i, str(2**40) + x if x else x, v, 1, 2) for i, x, v in rows], "vec_id long, label string, embedding array<double>, copies int, dim int")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.embedding_near_duplicates(vectors).collect()}
    assert got == {i: (0, i, True) for i in range(3, 13) if i != 11} | {1: (2, 1, True), 2: (2, 1, False), 11: (2, 1, False)}
    assert embedding_dedup.embedding_near_duplicates(vectors.where("vec_id = -1")).count() == 0
    whole = embedding_dedup.embedding_near_duplicates(vectors.withColumn("label", F.when(F.col("label").isNotNull(), F.lit(2**40)))).collect()
    assert {x.vec_id: x.n_links for x in whole}[10] == 3


def test_components_of_a_long_chain_and_a_star(spark):
    from freshet.llm.components import components

    chain = [(i, i + 1) for i in range(1000, 1600)] + [(5, i) for i in range(2000, 2400)]
    got = {x.node: x.label for x in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 1000 for i in range(1000, 1601)} | {i: 5 for i in [5, *range(2000, 2400)]}


def test_empty_tables(odd):
    none = odd.where("doc_id = -1")
    for f in (lambda d: minhash_dedup.near_duplicates(d), suffix_dedup.suffix_dedup, packing.pack, secret_scan.summary, secret_scan.scan, quality_rules.quality_rules, license_scan.license_scan, sentencepiece_fst.encoded):
        assert f(none).count() == 0


@pytest.mark.parametrize("name", ["op2_embedding_dedup", "op8_quality_rules"])
def test_against_duckdb(spark, sf_dir, name):
    got = Q.QUERIES[name](spark, sf_dir).toPandas()
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = db.execute(Q.ORACLE_SQL[name]).df()
    rows = lambda d: sorted(map(str, d[sorted(d)].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def documents(sf_dir):
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()


def test_minhash_against_all_pairs(spark, sf_dir):
    sets = {}
    for i, t in documents(sf_dir):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in Q.QUERIES["op1_minhash_dedup"](spark, sf_dir).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in ids}


def test_pieces_of_all_documents_equal_the_library(spark, sf_dir):
    import zlib

    import numpy as np
    import public_tokenizers
    import sentencepiece

    spm = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {x.doc_id: x for x in Q.QUERIES["op4_sentencepiece_fst"](spark, sf_dir).collect()}
    for i, t in documents(sf_dir):
        ids = spm.encode(t)
        assert (got[i].n_ids, got[i].ids_crc32, got[i].round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), spm.decode(ids) == t)


def test_packed_ids_of_all_documents_equal_the_tokenizer(spark, sf_dir):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, room = {}, Counter()
    for x in Q.QUERIES["op9_best_fit_packing"](spark, sf_dir).collect():
        got.setdefault(x.doc_id, []).append(x)
        room[x.sequence_id] += x.length
    total = 0
    for i, t in documents(sf_dir):
        ids = np.array([*coder.encode(t, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        pieces = sorted(got[i], key=lambda x: x.piece)
        assert [x.start for x in pieces] == np.cumsum([0, *(x.length for x in pieces[:-1])]).tolist() and sum(x.length for x in pieces) == len(ids)
        assert all(x.length == 2048 for x in pieces[1:]) and all(x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes()) for x in pieces)
    assert max(room.values()) <= 2048 and len(room) <= -(-total // 2048) + 1


def test_licence_base_columns_against_plain_loops(spark, sf_dir):
    phrases = {tuple(p.split()): label for p, label in license_scan.BASE_PHRASES.items()}
    got = {x.doc_id: x for x in Q.QUERIES["op7_license_scan"](spark, sf_dir).collect()}
    hits = 0
    for i, t in documents(sf_dir):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, label) for k in range(len(words)) for p, label in phrases.items() if tuple(words[k : k + len(p)]) == p]
        hits += len(at)
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({b for _, b in at})))
        assert {b for _, b in at} <= set(x.labels.split(",")) | {""} and 0 <= x.score <= 1
    assert hits


def test_secret_query_finds_every_planted_value(spark, sf_dir):
    got = {x.doc_id: x for x in Q.QUERIES["op3_secret_scan"](spark, sf_dir).collect()}
    planted = {i: len(re.findall(r'(?:token = "[0-9a-f]{40}"|AKIA[A-Z0-9]{16}|password=[0-9a-f]{12,})', t)) for i, t in documents(sf_dir)}
    assert all(got[i].n_secrets == n for i, n in planted.items())


def test_candidates_of_near_pairs_are_hardly_ever_missed():
    """Recall of the forest before its exact rest: pairs just above the threshold share a region in some tree."""
    import numpy as np

    rng, missed, total = np.random.default_rng(3), 0, 0
    factors = minhash_dedup.multipliers(128)
    orders = minhash_dedup.sequences(128, 16, 12)
    base = minhash_dedup.base_depth(0.85, 16)
    for _ in range(400):
        both, own = rng.integers(0, 1 << 63, 860).astype(np.uint64), rng.integers(0, 1 << 63, (2, 72)).astype(np.uint64)
        a, b = minhash_dedup.signatures([np.unique(np.concatenate([both, own[0]])), np.unique(np.concatenate([both, own[1]]))], factors)
        total += 1
        missed += not any((a[o[:base]] == b[o[:base]]).all() for o in orders)
    assert missed <= 0.01 * total


def test_minhash_hub_of_a_region_that_many_tasks_share(spark):
    """Variants that only the hub links, in a region spread over far more tasks than it has rows a task."""
    rng = random.Random(4)
    hub = [f"h{i}" for i in range(400)]
    texts = [" ".join(hub)]
    for k in range(300):
        at = rng.sample(range(2, 398), 10)
        texts.append(" ".join(f"v{k}x{i}" if i in at else w for i, w in enumerate(hub)))
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [set(zip(t.split(), t.split()[1:], t.split()[2:], strict=False)) for t in texts]
    linked = {i + 1 for i, s in enumerate(sets) if 100 * len(s & sets[0]) >= 85 * len(s | sets[0])}
    assert len(linked) > 250
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        got = {x.doc_id: x.component_id for x in minhash_dedup.near_duplicates(docs, 3, 0.85).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert {i for i, c in got.items() if c == 1} >= linked


def test_minhash_pairs_among_strangers_of_the_same_boilerplate(spark):
    """Strangers just below the threshold, pairs just above it."""
    both = [f"b{i}" for i in range(1000)]
    texts = []
    for k in range(400):
        shared = [f"p{k}x{i}" for i in range(27)]
        texts += [" ".join(both + shared + [f"{end}{k}x{i}" for i in range(75)]) for end in "yz"]
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [set(zip(t.split(), t.split()[1:], t.split()[2:], strict=False)) for t in texts]
    assert all(100 * len(sets[2 * k] & sets[2 * k + 1]) >= 85 * len(sets[2 * k] | sets[2 * k + 1]) for k in range(400))
    assert not any(100 * len(sets[0] & s) >= 85 * len(sets[0] | s) for s in sets[2:])
    got = {x.doc_id: x.component_id for x in minhash_dedup.near_duplicates(docs, 3, 0.85).collect()}
    assert got == {i: i - (i - 1) % 2 for i in range(1, 801)}


def test_suffix_against_all_windows(spark, sf_dir):
    raw = {i: t.encode() for i, t in documents(sf_dir)}
    count = Counter(hash(b[k : k + 200]) for b in raw.values() for k in range(len(b) - 199))
    got = {x.doc_id: (x.n_removed, x.kept_sha256) for x in Q.QUERIES["op10_suffix_dedup"](spark, sf_dir).collect()}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[hash(b[k : k + 200])] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert got[i] == (sum(gone), hashlib.sha256(kept).hexdigest())


def _fixture(spark, tmp_path):
    """A data set of documents and labels in which every stage has something to do."""
    rng, rows, marks = random.Random(21), [], []
    passage = " ".join(f"passage{i}" for i in range(70))
    for i in range(240):
        text = " ".join(rng.choice("the of and to in house tree river stone light water road over under between slowly".split()) + str(rng.randint(0, 99)) for _ in range(60))
        if i % 6 == 5:
            text = " ".join(w.upper() + "$$$ !!" for w in text.split())
        elif i % 20 == 1:
            text += " " + passage + f" end{i}"
        elif i % 20 == 2:
            text += f" password=ab{i}cd93ef{i}"
        elif i % 20 == 3:
            text = rows[i - 1][1] + " once more"
        rows.append((i, text, "en", "s", len(text)))
        if i % 3:
            marks.append((i, int(i % 6 != 5), 0))
    rows += [(900, None, "en", "s", None), (901, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, passage


def test_pipeline_against_plain_python(spark, tmp_path):
    """Every stage by brute force: the classifier's own score, all pairs, all windows, the scan's rule, the library's tokens."""
    import corpus_pipeline as P
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, passage = _fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality_classifier.trained(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), "quality", quality_classifier.crc_fold, 4, 2, 3000)
    kept = {i: t for i, t, *_ in rows if quality_classifier.score(t or "", model) >= 0.7}
    assert all(i in kept for i in range(240) if i % 6 != 5) and not any(i in kept for i in range(240) if i % 6 == 5)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in kept.items()}
    near = {b for a in kept for b in kept if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert near
    kept = {i: t for i, t in kept.items() if i not in near}
    raw = {i: (t or "").encode() for i, t in kept.items()}
    count = Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode()
    assert not any(passage in t for t in kept.values())
    kept = {i: re.sub(r"password=\S+", "password=[SECRET]", t) for i, t in kept.items()}
    assert sum("[SECRET]" in t for t in kept.values()) > 5
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(coder.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    got = P.run(spark, str(tmp_path)).collect()
    assert {x.doc_id: x.length for x in got} == want and all(x.piece == 0 for x in got)
    places = {}
    for x in got:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert all(sum(n for _, n in p) <= 2048 and all(o == sum(n for q, n in p if q < o) for o, _ in p) for p in places.values())
    assert len(places) == -(-sum(want.values()) // 2048)


def test_pipeline_of_no_rows_and_of_other_columns(spark, tmp_path):
    import corpus_pipeline as P

    _fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    none = docs.where("doc_id < 0")
    for _, stage in P.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    wide = docs.select("*", F.lit(1).alias("k1"), F.lit(2).alias("ranges"), F.lit(3).alias("spans"), F.lit(4).alias("score")).where("doc_id % 20 < 3")
    assert P.good_quality(spark, wide, str(tmp_path)).columns == P.COLUMNS
    for stage in (P.near_unique, P.without_repeats, P.without_secrets):
        assert stage(spark, wide, str(tmp_path)).columns == wide.columns


def test_pipeline_stages_follow_each_other(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = P.good_quality(spark, docs, sf_dir)
    assert good.columns == P.COLUMNS and 0.7 * docs.count() < good.count() < docs.count()
    unique = P.near_unique(spark, good, sf_dir)
    assert unique.count() == good.join(minhash_dedup.near_duplicates(good).where("kept"), "doc_id").count()
    assert [k for k, _ in P.STAGES] == ["quality classifier", "near-duplicates", "repeated passages", "secrets", "packing"]
    whole = P.run(spark, sf_dir)
    assert whole.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert whole.select("doc_id").distinct().count() == unique.count()
