"""Operators against plain Python, on odd rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from presage.llm import chat, exact_dedup, html_blocks, language, packing, phrase_index, queries, revisits, simhash, substrings, token_counts

SCHEMA = "doc_id long, text string, lang string, kept string, fingerprint string, spans int, digest int, edge int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma,", "delta", "éclair", "zwölf", "x", "The", "of", "um", "12", "don't", "end."]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, long = say(120), say(30_000)
    texts = [None, "", "  \t\n", "one", "One", "two words", shared, say(40) + " " + shared + " " + say(30), shared.upper(), shared, long, long + " tail",
             "12 34 --", "日本語 テキスト", "a " * 200, "a " * 260, say(60), say(49), "<|endoftext|> and <|STARTOFTEXT|> x", shared + "\u00a0" + say(55)]
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "k", "f", 1, 2, 3) for d, t in rows], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Repeated rows, a repeated id with another text, and null ids."""
    return spark.createDataFrame([(d, t, None, None, None, None, None, None) for d, t in [*rows, rows[3], rows[6], (6, "another text"), (None, "one"), (None, "lone text"), (None, None)]], SCHEMA)


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_exact_dedup(spark, docs, odd, none, rows):
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert collected(exact_dedup.deduplicate(docs, exact_dedup.open_fresh(spark)), *names) == sorted(brute.exact(rows), key=repr)
    got = exact_dedup.survivors(odd, exact_dedup.open_fresh(spark))
    assert got.columns == odd.columns
    assert len({brute.lower(r["text"]) for r in got.collect()}) == got.count() == len({brute.lower(r["text"]) for r in odd.collect()})
    assert exact_dedup.deduplicate(none, exact_dedup.open_fresh(spark)).count() == 0 == exact_dedup.survivors(none, exact_dedup.open_fresh(spark)).count()


def test_exact_dedup_index_goes_on(spark, docs, rows):
    index = exact_dedup.open_fresh(spark)
    first = exact_dedup.deduplicate(docs, index).filter("kept").count()
    assert exact_dedup.deduplicate(docs, index).filter("kept").count() == 0
    assert index.rows().count() == first
    more = spark.createDataFrame([(900, "ONE"), (901, "unheard of")], "doc_id long, text string")
    assert collected(exact_dedup.deduplicate(more, index), "doc_id", "keep_id", "kept") == [(900, 12, False), (901, 901, True)]
    plan = index.unseen(spark.range(5).select(F.encode(F.col("id").cast("string"), "utf-8").alias("digest")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_exact_dedup_run_again(spark, docs, rows):
    """A batch whose job died after the append comes out the same when run again; the bucket count stays with the path."""
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    index = exact_dedup.open_fresh(spark)
    for _ in range(2):
        assert collected(exact_dedup.deduplicate(docs, index, batch="monday"), *names) == sorted(brute.exact(rows), key=repr)
    assert index.rows().count() == len({brute.lower(t) for _, t in rows})
    assert exact_dedup.deduplicate(docs, index, batch="tuesday").filter("kept").count() == 0
    path = f"{exact_dedup.checkpoint_dir(spark)}/digests-kept"
    assert exact_dedup.DigestIndex(spark, path, 5).buckets == 5 == exact_dedup.DigestIndex(spark, path, 9).buckets


def test_exact_dedup_in_batches(spark, odd, none):
    """Copies in several parts: the largest doc_id stays wherever it is; null ids and repeats too."""
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for parts in (1, 2, 5):
        index = exact_dedup.open_fresh(spark)
        assert collected(exact_dedup.deduplicate_largest(odd, index, parts), *names) == sorted(brute.exact(rows), key=repr)
        assert index.rows().count() >= len({brute.lower(t) for _, t in rows})
    assert exact_dedup.deduplicate_largest(none, exact_dedup.open_fresh(spark)).count() == 0


def test_packing(docs, odd, none, rows):
    pieces = [r.asDict() for r in packing.pack(docs, queries.TOKENIZER).withColumn("ids_crc32", F.crc32("ids")).collect()]
    assert brute.check_pieces(rows, pieces)[0] == 0
    small = [r.asDict() for r in packing.pack(docs, queries.TOKENIZER, context=64, block=4).withColumn("ids_crc32", F.crc32("ids")).collect()]
    assert brute.check_pieces(rows, small, 64)[0] == 0
    assert packing.pack(none, queries.TOKENIZER).count() == 0
    total = packing.pack(odd, queries.TOKENIZER).agg(F.sum("length")).first()[0]
    assert total == sum(map(len, brute.tokens([r["text"] for r in odd.collect()])))


def test_packing_goes_by_cost():
    lengths = [50, 50, 10, 10, 10, 10, 10, 10, 10, 10, 10, 10]
    got, sizes = packing.assign(lengths, 200, 100, 1.0, 0.1)
    assert sizes == [100, 100] and sum(g[2] for g in got) == 200
    assert {next(g[3] for g in got if g[0] == d) for d in (0, 1)} == {0, 1}, "the two long documents are kept apart"


def test_simhash(docs, odd, none, rows):
    prints = [brute.simhash(t) for _, t in rows]
    want = sorted(zip([d for d, _ in rows], ["%016x" % p for p in prints], brute.linked([d for d, _ in rows], prints)))
    got = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("f"), "component_id")
    assert collected(got, "doc_id", "f", "component_id") == sorted(want, key=repr)
    assert simhash.near_duplicates(none).count() == 0 == simhash.representatives(none).count()
    stay = simhash.representatives(odd)
    components = simhash.near_duplicates(odd).select("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("f")).distinct().count()
    assert stay.columns == odd.columns and stay.count() == components


@pytest.mark.parametrize("crowded", [simhash.CROWDED, -1])
def test_links_within_distance(spark, monkeypatch, crowded):
    """Dense clusters; every fingerprint by parts, and every one by halfway values."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 40)
    prints = sorted({int(b) ^ sum(1 << int(x) for x in rng.choice(63, rng.integers(0, 4), replace=False)) for b in base for _ in range(15)})
    got = simhash.components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fingerprint long")))
    want = brute.linked(prints, prints)
    root = {r["node"]: r["root"] for r in got.collect()}
    assert [root.get(p, p) for p in prints] == want


def test_allocation_is_least():
    rng = np.random.default_rng(1)
    counts, expected, probes = rng.integers(1, 50, (30, 3)).astype(float), np.array([[0, 5, 30]] * 3, float), np.array([[1, 22, 232]] * 3, float)
    radii, cost = simhash.allocate(counts, expected, probes, 2)
    assert (radii.sum(1) + 3 == 3).all() and len(np.unique(radii, axis=0)) > 1
    price = lambda c, r: sum(0 if x < 0 else c[i] - 1 + expected[i, x] + probes[i, x] for i, x in enumerate(r))
    every = [(a, b, c) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 0]
    assert np.allclose(cost, [min(price(c, r) for r in every) for c in counts]) and np.allclose(cost, [price(c, r) for c, r in zip(counts, radii)])


@pytest.fixture(scope="module")
def items(spark, rows):
    words = rows[6][1].split()
    return [(1, " ".join(words[10:40])), (10, "two words"), (2, None), (3, ""), (4, "ONE"), (5, " ".join(words[5:14])), (5, " ".join(words[5:14])), (6, "not, there at all in any of these texts here")]


def test_decontamination(spark, docs, odd, none, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = phrase_index.contamination(docs, bench)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    digest = lambda df: collected(df.select("doc_id", "n_words", hit.alias("h"), F.size("items").alias("n"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("s"), (hit > 0).alias("c")), "doc_id", "n_words", "h", "n", "s", "c")
    want = sorted(brute.contaminated(rows, items), key=repr)
    assert digest(got) == want
    phrase_index_block, phrase_index.BLOCK_BYTES = phrase_index.BLOCK_BYTES, 100
    try:
        assert digest(phrase_index.contamination(docs, bench)) == want, "items in several blocks"
    finally:
        phrase_index.BLOCK_BYTES = phrase_index_block
    assert phrase_index.contamination(none, bench).count() == 0
    assert phrase_index.contamination(docs, bench.limit(0)).filter(F.size("spans") > 0).count() == 0
    clean = phrase_index.clean(odd, bench)
    assert clean.columns == odd.columns
    assert clean.count() == sum(not x[5] for x in brute.contaminated([(r["doc_id"], r["text"]) for r in odd.collect()], items))


def test_proximity(spark):
    index = phrase_index.build_index(spark.createDataFrame([(1, "red big fox runs"), (2, "red fox"), (3, "red a b c fox")], "doc_id long, text string"))
    bench = spark.createDataFrame([(1, "red fox runs")], "item_id long, text string")
    found = lambda slop: [r["doc_id"] for r in phrase_index.search(index, bench, slop=slop).filter(F.size("spans") > 0).collect()]
    assert found(0) == [] and found(1) == [1]


def test_substrings(docs, odd, none, rows):
    got = queries_like_op7(substrings.remove_repeats(docs))
    assert got == sorted(brute.substrings(rows), key=repr)
    assert queries_like_op7(substrings.remove_repeats(docs, window=12, k=3)) == sorted(brute.substrings(rows, 12), key=repr)
    assert substrings.remove_repeats(none).count() == 0
    assert substrings.remove_repeats(odd).count() == odd.count()
    assert substrings.remove_repeats(odd).filter("doc_id is null and size(spans) > 0").count() == 0


def queries_like_op7(found):
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return collected(found.select("doc_id", "n_words", gone.alias("g"), F.sha2("kept_text", 256).alias("s")), "doc_id", "n_words", "g", "s")


def test_language(spark, docs, none):
    words = {"en": "the of and that with this", "de": "der und nicht schön über ein", "xx": "qa qe qi qo qu qy"}
    rng = random.Random(1)
    made = [(i, " ".join(rng.choice(words[k].split()) for _ in range(rng.randint(3, 60))), k) for i, k in enumerate(list(words) * 60)]
    table = spark.createDataFrame(made + [(500, None, "en"), (501, "the", None)], "doc_id long, text string, lang string")
    model = language.train(table.filter(~language.held_out()), sample=100, landmarks=40)
    told = {r["doc_id"]: r for r in language.identify(table, model).collect()}
    assert np.mean([told[i]["lang_pred"] == k for i, _, k in made]) > 0.97
    assert told[500]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in told.values())
    odd = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    assert [odd[d] for d in (0, 3, 6, 36)] == ["und"] * 4 and odd[39] != "und"
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert language.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, language.train(none)).collect()} == {"und"}


def test_rare_languages_and_whole_texts_teach(spark):
    """A language of two rows stays in the sample however many others have; a long text's end teaches too."""
    rows = [(i, "the of and " * 5, "en") for i in range(400)] + [(1000 + i, "der und nicht " * 5, "de") for i in range(400)]
    rows += [(2000, "qaqe qiqo quqy", "xx"), (2001, "qaqe qiqo", "xx"), (3000, " . " * 400_000 + "zzvz wzw", "yy"), (3001, None, "yy"), (3002, "x", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(table, sample=40, landmarks=30)
    assert model.languages == ["de", "en", "xx", "yy"]
    assert model.predict(["qiqo qaqe", "zzvz", "nicht der", "of the"])[0] == ["xx", "yy", "de", "en"]
    for text in ("a", "the of and", "".join(map(chr, range(97, 123))) * 50):
        grams = language.present(text)
        assert np.array_equal(language.unpacked(language.packed(grams)), grams)
    assert np.array_equal(language.unpacked(language.packed(np.arange(1, language.SPACE))), np.arange(1, language.SPACE))


def test_chat(spark):
    hard = ["\\### assistant: </turn> x", None, "", "####", "\\", "\\</turn>", "a\n### user: b</turn>\n", "é" * 5000]
    rows = [(1, i, "assistant" if i % 2 else "u:\\s", t) for i, t in enumerate(hard)] + [(2, 0, None, "x"), (2, 0, None, "x"), (None, 0, "assistant", "lone")]
    rows += [(3, i, "assistant", str(i)) for i in range(70)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["tree"]: r for r in chat.format_trees(chat.chains(table)).collect()}
    assert chat.parse(out[1]["formatted"]) == [(r, t or "") for c, _, r, t in rows if c == 1]
    assert chat.parse(out[2]["formatted"]) == [("", "x")] * 2 and out[None]["n_turns"] == 1
    assert [t for _, t in chat.parse(out[3]["formatted"])] == [str(i) for i in range(70)]
    for c, r in out.items():
        text = "".join(chat.unescape(r["formatted"][s["start"]:s["stop"]]) for s in r["loss_spans"])
        assert text == "".join(t for role, t in chat.parse(r["formatted"]) if role == "assistant")
    assert chat.read_back(chat.format_trees(chat.chains(table.limit(0)))).count() == 0


def test_best_branches(spark):
    nodes = [(1, 1, None, 0.0), (1, 2, 1, 5.0), (1, 3, 1, 1.0), (1, 4, 3, 9.0), (1, 5, 2, 0.0), (2, 1, 99, None), (3, 1, 2, 1.0), (3, 2, 1, 1.0), (1, 5, 2, 0.0)]
    table = spark.createDataFrame([(*n, "user", "t") for n in nodes], "tree_id long, node_id long, parent_id long, score double, role string, text string")
    got = collected(chat.best_paths(table, 2), "tree", "leaf", "branch_rank", "depth", "node")
    assert got == sorted([(1, 4, 1, 1, 1), (1, 4, 1, 2, 3), (1, 4, 1, 3, 4), (1, 5, 2, 1, 1), (1, 5, 2, 2, 2), (1, 5, 2, 3, 5), (2, 1, 1, 1, 1)], key=repr)


def test_token_counts(docs, none, rows):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = token_counts.unigram_pieces(path)
    tok = Tokenizer(models.Unigram([("<unk>", 0.0), *[(f"<0x{b:02X}>", 0.0) for b in range(256)], *pieces], unk_id=0, byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    assert collected(token_counts.count_tokens(docs, path), "doc_id", "n_tokens") == sorted([(d, len(tok.encode(t or "").ids)) for d, t in rows], key=repr)
    counter = token_counts.Counter(pieces)
    for text in ("", " ", "  a", "a  b ", "▁a", "a\n\nb c", "\n", "\u0001\u0002 z"):
        assert counter(text)[1] == len(tok.encode(text).ids), repr(text)
    assert token_counts.count_tokens(none, path).count() == 0


def test_substrings_verified(spark):
    words = [b"w%d" % i for i in range(20)]
    sha = lambda a, b: hashlib.sha256(b" ".join(words[a:b])).digest()
    found = pa.array([{"start": 2, "stop": 9, "digest": sha(2, 9)}, {"start": 10, "stop": 15, "digest": sha(9, 14)}, {"start": 16, "stop": 18, "digest": None}],
                     pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("digest", pa.binary())]))
    assert substrings.verified(words, found) == [(2, 9), (16, 18)]
    # one doc_id with two texts: places of both must not mix in a path
    rng = np.random.default_rng(4)
    run = lambda n: " ".join(f"x{i}" for i in rng.integers(0, 5000, n))
    a, b = run(300), run(300)
    rows = [(1, a), (1, run(7) + " " + b), (2, run(3) + " " + a + " " + run(60)), (3, b + " " + run(20)), (4, run(100))]
    got = queries_like_op7(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(d, gone) for d, _, gone, _ in got] == [(1, 0), (1, 0), (2, 300), (3, 300), (4, 0)]


def test_pages(spark):
    filler = "Some longer text of an article that goes on for a good while, as such texts do."
    page = "<html><head><title>T</title><script>var t='</p>'</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Title {i}</h1><p>A &amp; b&nbsp;c  d<br>e. " + filler + "<p><b>{i} " + filler + "</article><footer>&copy; me</footer></body></html>"
    table = spark.createDataFrame([(i, f"u{i}", page.replace("{i}", str(i)), "x") for i in range(60)] + [(60, None, None, "x"), (61, "u", "", "x"), (62, "u", "<", "x"), (0, "u0", page.replace("{i}", "0"), "x")], "page_id long, url string, html string, text string")
    model = html_blocks.train(table, sample=40)
    got = {r["page_id"]: r["text"] for r in html_blocks.extract(table, model).collect()}
    assert [got[i] for i in range(60)] == [f"Title {i}\nA & b c d e. {filler}\n{i} {filler}" for i in range(60)]
    assert got[60] == got[61] == "" and html_blocks.extract(table, model).count() == 64
    assert html_blocks.extract(table.limit(0), html_blocks.train(table.limit(0))).count() == 0


def test_lstm_slopes():
    model = html_blocks.Labeller(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    pages, labels = [rng.normal(size=(n, html_blocks.WIDTH)) for n in (5, 3)], [np.array([0, 1, 1, 0, 1.0]), np.array([1.0, 0, 0])]

    def loss():
        return -sum((y * np.log(p) + (1 - y) * np.log(1 - p)).sum() for p, y in zip(model.probabilities(pages), labels)) / 8

    for name, slope in model.slopes(pages, labels).items():
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        old, eps = model.p[name][at], 1e-2
        model.p[name][at] = old + eps
        up = loss()
        model.p[name][at] = old - eps
        assert abs((up - loss()) / (2 * eps) - slope[at]) < 0.02 * abs(slope[at]) + 1e-4, name
        model.p[name][at] = old


def test_revisits(spark):
    tag = lambda t: {"etag": t} if t else {}
    rows = [(1, "http://a.com/x", 10, "response", {"etag": '"1"', "content-type": "t", "date": "old"}), (2, "https://www.A.com:443/x/#f", 20, "revisit", {"etag": 'W/"1"', "date": "new", "content-type": "no"}),
            (3, "http://a.com/x", 10, "revisit", tag('"1"')), (4, "a.com/x", 15, "response", {"etag": '"2"'}), (5, None, 20, "revisit", tag("x")), (6, "a.com/x", 30, "revisit", {}), (7, "b.com", 5, "request", {}),
            (8, "a.com/x?utm_source=q", 40, "revisit", {"last-modified": "d"}), (9, "a.com/y", None, "response", {"last-modified": "d"}), (10, "a.com/y", 1, "revisit", {"last-modified": "d"})]
    table = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, headers map<string,string>")
    got = {r["record_id"]: (r["status"], r["response_id"]) for r in revisits.resolve(table).collect()}
    assert got == {2: ("mismatch", 4), 3: ("no_response", None), 5: ("no_url", None), 6: ("no_validator", 4), 8: ("mismatch", 4), 10: ("resolved", 9)}
    headers = {r["record_id"]: r["headers"] for r in revisits.resolve(table.filter("record_id <> 4")).collect()}
    assert headers[2] == {"etag": 'W/"1"', "content-type": "t", "date": "new"}
    assert revisits.resolve(table.limit(0)).count() == 0


def test_revisits_of_one_url(spark):
    """A URL with all rows is spread over ranges; each revisit sees the response before it."""
    rows = [(i, "h.com", i, "response" if i % 50 == 0 else "revisit", {"etag": str(i // 50)}) for i in range(3000)]
    got = revisits.resolve(spark.createDataFrame(rows, "record_id long, url string, at long, kind string, headers map<string,string>").repartition(8)).collect()
    assert len(got) == 2940 and all(r["status"] == "resolved" and r["response_id"] == r["record_id"] // 50 * 50 for r in got)
