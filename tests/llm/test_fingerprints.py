import hashlib
import random

from pyspark.sql import functions as F

from barquet.llm import fingerprints as fp


def order_key(r):
    return ((1 << 63) - 1 if r[0] is None else r[0])


def test_edited_texts_lengths_and_next(spark, make_docs):
    rng = random.Random(4)
    rows = [(i * 3, " ".join(rng.choice(["alpha", "beta", "gamma", "délta", "eta"]) for _ in range(rng.randint(0, 40))), "en", "a") for i in range(60)]
    rows += [(None, "the very last", "en", "a"), (1, None, "en", "a"), (2, "", "en", "a"), (4, "long " * 20000, "en", "a")]
    got = {r["doc_id"]: r for r in fp.fingerprint_documents(make_docs(rows)).collect()}
    own = sorted(rows, key=order_key)
    assert len(got) == len(rows)
    for k, r in enumerate(own):
        t, nxt = r[1] or "", own[(k + 1) % len(own)][1] or ""
        q = len(t) // 4
        edited = t[:len(t) - q] + nxt[:q]
        g = got[r[0]]
        assert g["n_chars"] == len(t)
        assert g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
        assert len(g["fingerprint"]) == len(g["edited_fingerprint"]) == 32


def test_repeated_rows_are_computed_once_and_all_returned(make_docs):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(18)) for _ in range(n))
    single = [(1, text(30), "en", "a"), (2, text(2000), "en", "a"), (3, text(2000), "en", "a"), (4, text(50), "en", "a"), (7, None, "en", "a"), (None, text(300), None, None)]
    times = [1, 12, 9, 1, 3, 40]
    alone = {r["doc_id"]: r for r in fp.fingerprint_documents(make_docs(single)).collect()}
    got = fp.fingerprint_documents(make_docs([r for r, n in zip(single, times) for _ in range(n)])).collect()
    assert all(r == alone[r["doc_id"]] for r in got)
    ids = [r["doc_id"] for r in got]
    assert [ids.count(r[0]) for r in single] == times and len(got) == sum(times)
    # a null text and an empty one with the same id are equal; LAST_ID is not null
    odd = fp.fingerprint_documents(make_docs([(5, None, "en", "a"), (5, "", "en", "a"), (fp.LAST_ID, "x y", "en", "a"), (None, "x y", "en", "a")])).collect()
    assert sorted((str(r["doc_id"]) for r in odd)) == sorted(["5", "5", str(fp.LAST_ID), "None"])


def test_equal_texts_equal_fingerprints_and_shared_words_change_nothing(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.randint(0, 5000))) for _ in range(20)] + ["", " ", "one", "one  two"]
    rows = [(i, t, t[:len(t) // 2] + "zz" + t[:9]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i long, text string, edited string")
    alone = {r["i"]: r for r in fp.fingerprints(df.withColumn("common", F.lit(0).cast("long")), ["i"], ["text"]).collect()}
    common = F.size(F.split(F.substring("text", F.lit(1), (F.length("text") / 2).cast("int")), " ")) - 1
    both = {r["i"]: r for r in fp.fingerprints(df.withColumn("common", common), ["i"], ["text", "edited"]).collect()}
    edited = {r["i"]: r for r in fp.fingerprints(df.select("i", F.col("edited").alias("text"), F.lit(0).cast("long").alias("common")), ["i"], ["text"]).collect()}
    for i in alone:
        assert (alone[i]["f0_0"], alone[i]["f0_1"]) == (both[i]["f0_0"], both[i]["f0_1"])
        assert (edited[i]["f0_0"], edited[i]["f0_1"]) == (both[i]["f1_0"], both[i]["f1_1"])


def test_edits_stay_nearer_than_the_next_document(spark):
    rows = fp.fingerprint_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).filter("n_chars > 200").collect()
    assert sum(r["near_edited"] > r["near_next"] for r in rows) >= 0.95 * len(rows)


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(6)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = [rng.getrandbits(128) for _ in range(40)]
    for p in prints[:20]:
        for _ in range(6):
            for b in rng.sample(range(128), rng.randint(0, 5)):
                p ^= 1 << b
            prints.append(p)
    df = spark.createDataFrame([(signed(p >> 64), signed(p & ((1 << 64) - 1))) for p in prints + prints[:5]], "f0 long, f1 long")
    queries = df.limit(25)
    asked = {tuple(r) for r in queries.collect()}
    every = {tuple(r) for r in df.collect()}
    bits = lambda a, b: bin((a[0] ^ b[0]) & ((1 << 64) - 1)).count("1") + bin((a[1] ^ b[1]) & ((1 << 64) - 1)).count("1")
    want = sorted((*q, *p, bits(q, p)) for q in asked for p in every if bits(q, p) <= 3)
    assert sorted(map(tuple, fp.near_fingerprints(queries, df, radius=3, blocks=6).collect())) == want
    assert len(want) > len(asked)


def test_empty_and_single_tables(make_docs):
    assert fp.fingerprint_documents(make_docs([])).collect() == []
    one = fp.fingerprint_documents(make_docs([(5, "alone here", "en", "a")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_main_path_has_no_python(spark, make_docs):
    plan = fp.fingerprint_documents(make_docs([(1, "a b", "en", "a"), (2, "b c", "en", "a")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
