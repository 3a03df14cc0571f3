import zlib

import numpy as np
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from logweir.llm import chat, common, lines, mixing, neighbours, packing, pii, quality, queries, scoring, sharding, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, w string, size long, slot long"


def docs_of(spark, texts, sources=None):
    """Documents with columns whose names clash with those of the operators."""
    rows = [(i, t, "en", sources[i] if sources else "s", len(t or ""), "x", 5, 6) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t ", "one two three", "one two three", "word " * 60, "a\nb\na\n", "x" * 3000, "é ü 漢字 ...  z"]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD, [None, "b", "b", "a", "a", "a", None, "c", "c"])


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(same, name):
    same(queries.QUERIES[name], queries.ORACLES[name])


def test_quality_on_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in quality.assess(odd).collect()}
    assert [got[i]["n_words"] for i in range(9)] == [0, 0, 0, 3, 3, 60, 3, 1, 5]
    assert got[5]["n_repeat_words"] == 60 and got[5]["base_failed"] and not got[5]["kept"]
    assert got[6]["n_dup_lines"] == 1
    assert quality.keep_good(none).columns == none.columns and quality.keep_good(none).count() == 0


def test_quality_rejects_no_text_for_its_length(spark):
    clean = {"n_words": 2_000_000, "n_repeat_words": 0, "mean_word_chars": 5.0, "symbol_ratio": 0.0, "n_stop_words": 9}
    clean |= {"letter_word_ratio": 1.0, "dup_line_ratio": 0.0, "bullet_line_ratio": 0.0, "ellipsis_line_ratio": 0.0}
    metrics = F.struct(*[F.lit(v).alias(k) for k, v in clean.items()])
    assert spark.range(1).select(metrics.alias("m")).select(quality.verdict(F.col("m"))).first()[0]


@pytest.mark.parametrize("bits,hashes", [((16, 24, 32), 1 << 62), ((16, 24, 32), 5), ((4, 24, 32), 1 << 62), ((4, 6, 32), 40)])
def test_repeated_windows_against_brute_force(spark, monkeypatch, bits, hashes):
    """Also where hashes collide and where a long text's keys have few hash bits."""
    monkeypatch.setattr(quality, "START_BITS", bits)
    monkeypatch.setattr(quality, "window_hash", lambda *c: F.pmod(F.xxhash64(*c), F.lit(hashes)) * F.lit((1 << 63) // hashes - 1))
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdef"), rng.integers(0, 120))) for _ in range(60)] + ["x y z", "x y z x y z", "a a a a"]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.assess(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        found = {}
        for at in range(len(w) - 2):
            found.setdefault(tuple(w[at : at + 3]), []).append(at)
        assert got[i] == len({a + k for ats in found.values() if len(ats) > 1 for a in ats for k in range(3)})


def test_mixing_on_odd_rows(odd, none):
    got = mixing.plan(odd).collect()
    assert len(got) == 9 and all(r["taken"] <= 3 * r["size"] for r in got)
    for source in {(r["__null"], r["__source"]) for r in got}:
        own = [r for r in got if (r["__null"], r["__source"]) == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 1
    assert mixing.plan(none).count() == 0 and mixing.mix(odd).columns == odd.columns


def brute_fingerprint(text):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    parts = [b" ".join(tokens[i : i + 4]) for i in range(max(1, len(tokens) - 3))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = list(prints)
    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {p: find(p) for p in known}


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {d: brute_fingerprint(t) for d, t in texts.items()}
    of = components_of(set(prints.values()))
    first = {}
    for d in sorted(prints):
        first.setdefault(of[prints[d]], d)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op4_simhash(spark, SF).collect()}
    assert got == {d: (f"{p:016x}", first[of[p]]) for d, p in prints.items()}


def test_simhash_on_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in simhash.classes(odd).collect()}
    assert got[0]["fp"] == got[1]["fp"] == got[2]["fp"] == 0 and got[4]["component_id"] == 3
    assert simhash.classes(none).count() == 0


@pytest.mark.parametrize("block", [simhash.FILE_BLOCK, (3, 3)])
def test_links_miss_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "FILE_BLOCK", block)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40)
    flips = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 7), replace=False)) for b in np.repeat(base, 8)]
    prints = sorted(set(flips))
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    of = components_of(prints)
    ours, theirs = {}, {}
    for p in prints:
        ours.setdefault(roots.get(p, p), set()).add(p)
        theirs.setdefault(of[p], set()).add(p)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


@pytest.mark.parametrize("block", [simhash.FILE_BLOCK, (1, 1)])
def test_drop_copies_keeps_one_of_each(spark, odd, none, monkeypatch, block):
    words = [f"w{i}" for i in range(400)]
    near = words[:200] + ["changed"] + words[201:]
    texts = [" ".join(words), " ".join(words), " ".join(near), " ".join(f"v{i}" for i in range(300))]
    monkeypatch.setattr(simhash, "FILE_BLOCK", block)
    assert sorted(r["doc_id"] for r in simhash.drop_copies(docs_of(spark, texts)).collect()) == [0, 3]
    kept = simhash.drop_copies(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {3, 5, 7}
    assert simhash.drop_copies(none).count() == 0


def planted_pairs():
    """Pairs of texts whose 5-word shingle sets have a similarity between 0.5 and 1, and three that chain."""
    rng, texts = np.random.default_rng(7), []
    for at in range(160):
        base = [f"w{at}x{i}" for i in range(int(rng.integers(12, 300)))]
        other = list(base)
        for i in rng.choice(len(base), max(1, int(len(base) * rng.uniform(0.005, 0.07))), replace=False):
            other[i] = f"new{at}x{i}"
        texts += [" ".join(base), " ".join(other[: int(len(base) * rng.uniform(0.9, 1)) + 1])]
    chain = [f"c{i}" for i in range(120)]
    return texts + [" ".join(chain[i : i + 100]) for i in (0, 9, 18)]


@pytest.mark.parametrize("block", [simhash.SET_BLOCK, 60])
def test_near_copies_are_those_of_similarity(spark, monkeypatch, block):
    texts = planted_pairs()
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(texts)))
    between = 0
    for x in range(len(texts)):
        for y in range(x):
            shared = len(sets[x] & sets[y])
            union = len(sets[x]) + len(sets[y]) - shared
            between += 6 * union <= 10 * shared < 9 * union
            if 10 * shared >= 8 * union:
                a, b = root[x], root[y]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert between > 60 and len(set(root)) < len(texts) - 40
    monkeypatch.setattr(simhash, "SET_BLOCK", block)
    assert sorted(r["doc_id"] for r in simhash.drop_copies(docs_of(spark, texts)).collect()) == sorted(set(root))


def test_near_duplicates_on_large_copy_groups(spark):
    words = [f"w{i}" for i in range(120)]
    near = [" ".join([*words[:60], f"changed{i}", *words[61:]]) for i in range(300)]
    docs = docs_of(spark, ["one text " * 40] * 400 + near + ["another text altogether"])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [0, 400, 700]


def test_line_index_is_reversible(spark, odd, none):
    docs = docs_of(spark, [f"Shared line \nown {i}\n" for i in range(12)])
    index = lines.LineIndex.empty(spark).insert(docs)
    assert {r["text"] for r in index.drop_common(docs).collect()} == {f"own {i}\n" for i in range(12)}
    less = index.delete(docs.filter("doc_id >= 9"))
    assert {r["text"] for r in less.drop_common(docs).collect()} == {f"Shared line \nown {i}\n" for i in range(12)}
    assert index.delete(docs).refs.count() == 0
    assert lines.LineIndex.empty(spark).insert(odd).drop_common(odd).count() == 9
    assert lines.LineIndex.empty(spark).insert(none).drop_common(none).count() == 0


@pytest.mark.parametrize("sent", [True, False])
def test_line_index_however_the_filters_travel(spark, monkeypatch, sent):
    """The shards are doubled and, unless sent, filters and lines meet by shard; a line has half of all rows."""
    monkeypatch.setattr(lines, "SHARD_KEYS", 2)
    monkeypatch.setattr(lines, "BROADCAST_BYTES", lines.BROADCAST_BYTES if sent else 0)
    texts = [f"Everywhere\nown {i}\ngroup {i % 20}\n\n everywhere " for i in range(300)] + [None, ""]
    index = lines.LineIndex.empty(spark, shards=2).insert(docs_of(spark, texts))
    assert index.shards > 2
    got = {r["doc_id"]: r["text"] for r in index.drop_common(docs_of(spark, texts)).collect()}
    assert got == {i: (f"own {i}\n" if t else t) for i, t in enumerate(texts)}
    more = index.insert(docs_of(spark, [f"own {i % 3}" for i in range(30)]))
    kept = {r["text"] for r in more.drop_common(docs_of(spark, texts[:4])).collect()}
    assert kept == {"", "own 3\n"}


@pytest.mark.parametrize("hot_keys", [4096, 4, 1])
def test_spread_join_is_a_join(spark, monkeypatch, hot_keys):
    """Half of the rows under one key, some keys absent on the other side, null keys."""
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    rows = spark.createDataFrame([(None if i % 50 == 0 else 0 if i % 2 else i % 13, i) for i in range(600)], "k int, v int")
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k <> 5").withColumn("x", F.col("k") * 2)
    for how in ("inner", "left"):
        got = common.spread_join(rows, keyed, "k", "n", 600, how)
        want = rows.join(keyed.drop("n"), "k", how)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_row_ids_tell_rows_apart(spark):
    rows = spark.createDataFrame([("a", "b:c"), ("a:b", "c"), (None, "x"), ("~", "x"), ("a", None), ("a", "")], "doc_id string, text string")
    assert rows.select(lines.row_id()).distinct().count() == 6


def test_cuckoo_filter():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64)
    made = lines.CuckooFilter.built(keys)
    assert made.has(keys).all()
    assert made.insert(np.zeros(0, np.uint64)) and (made.cells != 0).sum() == len(keys)
    assert all(made.delete(int(k)) for k in keys[:1000]) and made.has(keys[1000:]).all()
    assert made.has(keys[:1000]).mean() < 0.05


@pytest.mark.parametrize("held", [scoring.HELD_WORDS, 50])
def test_scores_against_a_plain_model(spark, monkeypatch, held):
    """Every score by a loop over its words, with most words outside of what is sent."""
    monkeypatch.setattr(scoring, "HELD_WORDS", held)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    counts = scoring.word_counts(docs)
    vocabulary = scoring.Vocabulary.fitted(counts, 300)
    network = scoring.train(docs, vocabulary, rounds=2)
    got = {r["doc_id"]: r for r in scoring.score(docs, counts, vocabulary, network).collect()}
    texts = {r["doc_id"]: (r["text"] or "").lower().encode().split() for r in docs.collect()}
    total = {}
    for words in texts.values():
        for w in words:
            total[w] = total.get(w, 0) + 1
    assert len(vocabulary.known) <= 300 < len(total) and {w: n for w, (_, n) in vocabulary.known.items()}.items() <= total.items()
    leaf = lambda w: vocabulary.known[w][0] if w in vocabulary.known else scoring.shared_leaf(w)
    members = {}
    for w in total:
        members.setdefault(leaf(w), []).append(w)
    for d in list(texts)[:40]:
        words, want = texts[d], 0.0
        padded = [scoring.END] * 2 + [leaf(w) for w in words] + [scoring.END] * 2
        for i, w in enumerate(words):
            around = np.array([[padded[i + 2 + p] for p in scoring.SIDES]])
            want += network.log_probabilities(around, np.array([leaf(w)]))[0]
            if leaf(w) >= scoring.OWN:
                mine = members[leaf(w)]
                others = sum(total[x] - words.count(x) for x in mine)
                want += np.log((total[w] - words.count(w) + scoring.UNSEEN) / (others + scoring.UNSEEN * (len(mine) + 1)))
        assert got[d]["n_words"] == len(words) and abs(got[d]["log_likelihood"] - want) < 1e-4 * abs(want) + 1e-6


def test_network_gradient_against_differences():
    rng = np.random.default_rng(0)
    around = rng.integers(0, scoring.LEAVES + 1, (40, 4))
    leaf = rng.integers(0, 200, 40)
    net = scoring.Network([p.astype(np.float64) for p in scoring.Network.started(np.ones(scoring.LEAVES)).parts])
    for p in net.parts[2:]:
        p += rng.normal(0, 0.1, p.shape)
    loss = lambda: -net.log_probabilities(around, leaf).mean()
    back, grads = net.gradient(around, leaf)
    full = np.zeros_like(net.embed)
    for p in range(4):
        np.add.at(full[p], around[:, p], back)
    for part, grad in zip(net.parts, [full, *grads]):
        for at in zip(*(rng.choice(x, 8) for x in np.nonzero(grad))):
            old = part[at]
            part[at] = old + 1e-5
            up = loss()
            part[at] = old - 1e-5
            down = loss()
            part[at] = old
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-6


def test_probabilities_sum_to_one():
    net = scoring.Network.started(np.arange(scoring.LEAVES) % 7)
    around = np.repeat([[0, 5, scoring.END, 9]], scoring.LEAVES, axis=0)
    assert abs(np.exp(net.log_probabilities(around, np.arange(scoring.LEAVES))).sum() - 1) < 1e-3


def test_network_beats_counts_held_out(spark):
    """Trained on nine tenths, it predicts the leaves of the others better than their counts, and than pairs of neighbours."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    counts = scoring.word_counts(docs)
    vocabulary = scoring.Vocabulary.fitted(counts)
    train = docs.filter("doc_id % 10 <> 0").repartition(4)
    network = scoring.train(train, vocabulary)
    look = scoring.Lookup(vocabulary)
    ids = lambda df: scoring.windows(look.marked(*look.codes(df.select(F.encode(F.lower("text"), "UTF-8").alias("t")).toArrow().column("t").combine_chunks())))
    (seen, target), (around, leaf) = ids(train), ids(docs.filter("doc_id % 10 = 0"))
    alone = (np.bincount(target, minlength=scoring.LEAVES) + 0.1) / (len(target) + 0.1 * scoring.LEAVES)
    pairs, firsts, kinds = {}, {}, {}
    for a, b in zip(seen[:, 1].tolist(), target.tolist()):
        kinds[a] = kinds.get(a, 0) + ((a, b) not in pairs)
        pairs[a, b], firsts[a] = pairs.get((a, b), 0) + 1, firsts.get(a, 0) + 1
    bigram = [
        (max(pairs.get((a, b), 0) - 0.75, 0) + 0.75 * kinds[a] * alone[b]) / firsts[a] if a in firsts else alone[b]
        for a, b in zip(around[:, 1].tolist(), leaf.tolist())
    ]
    ours = network.log_probabilities(around, leaf).mean()
    assert ours > np.log(bigram).mean() > np.log(alone[leaf]).mean()


def test_scores_on_odd_rows(spark, odd, none):
    counts = scoring.word_counts(odd)
    vocabulary = scoring.Vocabulary.fitted(counts)
    network = scoring.train(odd, vocabulary, rounds=1)
    got = {r["doc_id"]: r for r in scoring.score(odd, counts, vocabulary, network).collect()}
    assert len(got) == 9 and all((got[i]["n_words"], got[i]["log_likelihood"], got[i]["mean_log_likelihood"]) == (0, 0.0, None) for i in range(3))
    assert got[3]["log_likelihood"] == got[4]["log_likelihood"]
    empty = scoring.Vocabulary.fitted(scoring.word_counts(none))
    assert scoring.score(none, scoring.word_counts(none), empty, scoring.train(none, empty, rounds=1)).count() == 0
    assert scoring.word_hash("漢字 é".encode()) == spark.sql("SELECT xxhash64(CAST('漢字 é' AS BINARY))").first()[0]


def test_a_text_known_twice_scores_higher(spark):
    rng = np.random.default_rng(1)
    made = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(4000)]
    texts = [" ".join(made[60 * i : 60 * i + 60]) for i in range(60)]
    docs = docs_of(spark, texts + texts[:10])
    counts = scoring.word_counts(docs)
    vocabulary = scoring.Vocabulary.fitted(counts)
    network = scoring.Network.started(vocabulary.tokens)
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in scoring.score(docs, counts, vocabulary, network).collect()}
    assert min(got[i] for i in range(10)) > max(got[i] for i in range(10, 60))


def test_sharding(spark, odd, none):
    root, grown = sharding.tree(16), sharding.tree(17)
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.assign(ids, root, grown).collect()
    sizes = np.bincount([r["shard"] for r in got], minlength=16)
    assert sizes.min() > 1000 and sizes.max() < 1500
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)
    for shard in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sizes[shard]))
    odd_rows = {r["doc_id"]: r for r in sharding.assign(odd, root, grown).collect()}
    assert odd_rows[0]["size"] == 1 and odd_rows[3]["text_crc32"] == zlib.crc32(b"one two three")
    assert sharding.assign(none, root, grown).count() == 0


def test_shards_grow_into_themselves():
    hashes = np.random.default_rng(2).integers(0, 1 << 64, 50_000, np.uint64)
    before = sharding.descend(sharding.tree(16), hashes)
    for n in (17, 18, 19):
        after = sharding.descend(sharding.tree(n), hashes)
        assert set(after[after != before]) == {n - 1} and 0.7 < (after == n - 1).mean() * n < 1.3
        before = after


def test_moves_stay_in_the_subtrees_whose_weights_change():
    """A shard's weight doubled: documents only enter its region, its rack and itself, at each level."""
    hashes = np.random.default_rng(3).integers(0, 1 << 64, 50_000, np.uint64)
    root = sharding.tree(16)
    heavy = sharding.Node("root", tuple(
        sharding.Node(r.name, tuple(sharding.Node(k.name, tuple(sharding.leaf(x.shard, 2.0 if x.shard == 5 else 1.0) for x in k.children)) for k in r.children))
        for r in root.children
    ))
    before, after = sharding.descend(root, hashes), sharding.descend(heavy, hashes)
    moved = before != after
    assert moved.any() and set(after[moved] // 4) == {1}
    inside = moved & (before // 4 == 1)
    assert set(after[inside] // 2) == {2} and set(after[inside & (before // 2 == 2)]) == {5}


def test_shards_on_repeated_ids(spark):
    docs = spark.createDataFrame([(i // 3, f"t{i % 2}") for i in range(300)] + [(None, None)] * 5, "doc_id long, text string")
    got = sharding.assign(docs, sharding.tree(4), sharding.tree(5)).collect()
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], set()).add(r["shard"])
    assert len(got) == 305 and all(len(x) == 1 for x in of.values())
    for shard in range(4):
        own = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert own == list(range(len(own)))


def test_pii(spark, none):
    texts = [
        "Write to Ann.Lee@Example.com or ann.lee@example.com, or bob@example.com.",
        "Call +1 555 201 3344 or 555-201-3344; SSN 123-45-6789.",
        "Card 4111 1111 1111 1111, order 1234567890123456, host 10.0.12.7.",
        "Mr. John Smith met Mrs. Smith. token = \"abcdEFGH1234\"",
        "A clean text, version 1.2.3, in 2024.",
        None,
        "",
    ]
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs_of(spark, texts), "key").collect()}
    first = got[0]["text"].replace(",", "").split()
    assert first[2].lower() == first[4].lower() != first[6].rstrip(".").lower() and "example.com" not in got[0]["text"].lower().replace("example.org", "")
    assert "555-201-3344" not in got[1]["text"] and "123-45-6789" not in got[1]["text"]
    assert "1234567890123456" in got[2]["text"] and "4111 1111" not in got[2]["text"] and "10.0.12.7" not in got[2]["text"]
    assert got[3]["text"].startswith("Mr. ") and "Smith" not in got[3]["text"] and "abcdEFGH" not in got[3]["text"]
    assert got[4]["text"] == texts[4] and got[5]["text"] is None and got[6]["text"] == ""
    again = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs_of(spark, texts), "key").collect()}
    assert again == {k: r["text"] for k, r in got.items()}
    assert pii.pseudonymise(none, "key").count() == 0


def test_pii_mentions_agree(spark):
    texts = [
        "Mr. John Smith, Mr. Smith and Dr. Smith.",
        "+1 555 201 3344 or 555-201-3344",
        "г-н Иванов, господин Иванов, κύριος Ανδρέου",
        "Prof. Jane McDonald, Mrs. J. O'Brien",
        """password: 'qwertz-1234' and "api_key": "qwertz-1234" """,
    ]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs_of(spark, texts), "key").collect()}
    full, short, doctor = got[0].rstrip(".").replace(" and", ",").replace(",,", ",").split(", ")
    assert full.split()[2] == short.split()[1] == doctor.split()[1] != "Smith" and full.split()[1] != "John"
    national, local = got[1].split(" or ")
    assert national.startswith("+1 ") and national[3:].replace(" ", "-") == local != "555-201-3344"
    first, second, greek = (x.split()[1] for x in got[2].split(", "))
    assert first == second != "Иванов" and greek != "Ανδρέου"
    assert not any(x in got[3] for x in ("Jane", "Mc", "Donald", "Brien")) and "Mrs. J. " in got[3]
    secret = got[4].split("'")[1]
    assert secret != "qwertz-1234" and f'"api_key": "{secret}"' in got[4]


def luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10


def iban_rest(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_pii_distinct_and_coreferent(spark):
    """Entities of every type, written in several ways, against what a plain reading of them says."""
    rng = np.random.default_rng(11)
    digit = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pools = {
        "family": [f"Fam{''.join(rng.choice(list('aeiou'), 4))}" for _ in range(12)],
        "given": ["Adam", "Boris", "Carl", "Emil", "Otto", "Paul"],
        "phone": ["".join(["2", digit(2), "3", digit(6)]) for _ in range(12)],
        "card": [b + str((10 - luhn(b + "0")) % 10) for b in ("4" + digit(14) for _ in range(8))],
        "ssn": [digit(9) for _ in range(12)],
        "iban": [f"DE{98 - iban_rest('DE00' + b):02d}{b}" for b in (digit(18) for _ in range(8))],
        "email": [f"user{i}@mail{i % 3}.example.com" for i in range(12)],
    }
    shown = {
        "family": [lambda x: f"Mr. {x}", lambda x: f"Dr. {x}"],
        "given": [lambda x: f"Mr. {x} Smith"],
        "phone": [lambda x: f"+1 {x[:3]} {x[3:6]} {x[6:]}", lambda x: f"({x[:3]}) {x[3:6]}-{x[6:]}", lambda x: f"{x[:3]}.{x[3:6]}.{x[6:]}", str],
        "card": [str, lambda x: "-".join(x[i : i + 4] for i in range(0, 16, 4))],
        "ssn": [lambda x: f"{x[:3]}-{x[3:5]}-{x[5:]}", lambda x: f"SSN {x}"],
        "iban": [str, lambda x: " ".join(x[i : i + 4] for i in range(0, len(x), 4))],
        "email": [str, str.upper],
    }
    said = []
    for kind, pool in pools.items():
        for x in pool:
            said += [(kind, x, way(x)) for way in shown[kind]]
    order = rng.permutation(len(said))
    docs = docs_of(spark, [f"we know: {said[i][2]} ;" for i in order])
    got = {r["doc_id"]: r["text"][9:-2] for r in pii.pseudonymise(docs, "k").collect()}
    plain = {
        "family": lambda t: t.split()[-1], "given": lambda t: t.split()[1], "email": str.lower, "iban": lambda t: t.replace(" ", ""),
        "phone": lambda t: "".join(c for c in t if c.isdigit())[-10:], "ssn": lambda t: "".join(c for c in t if c.isdigit()),
        "card": lambda t: "".join(c for c in t if c.isdigit()),
    }
    found = {}
    for at, i in enumerate(order):
        kind, x, text = said[i]
        assert got[at] != text and len(got[at].split()) == len(text.split())
        found.setdefault((kind, x), set()).add(plain[kind](got[at]))
        if kind not in ("family", "given", "email"):
            mask = lambda t: "".join("9" if c.isalnum() else c for c in t)
            assert mask(got[at]) == mask(text)
    assert all(len(v) == 1 for v in found.values())
    for kind, pool in pools.items():
        own = {next(iter(found[kind, x])) for x in pool}
        assert len(own) == len(pool) and not own & {plain[kind](x) if kind not in ("family", "given") else x for x in pool}
    assert all(luhn(next(iter(found["card", x]))) == 0 for x in pools["card"])
    assert all(iban_rest(next(iter(found["iban", x]))) == 1 for x in pools["iban"])


def test_pii_short_names_do_not_run_out(spark):
    two = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "abcdefghijklmnopqrstuvwxyz"]
    texts = [f"Mr. {w} met Mrs. {w}." for w in [*two, *[w + "x" for w in two[:50]]]]
    got = [r["text"] for r in pii.pseudonymise(docs_of(spark, texts), "key").collect()]
    names = [(t.split()[1], t.split()[4].rstrip(".")) for t in got]
    assert all(a == b for a, b in names) and len({a for a, _ in names}) == len(texts) and not {a for a, _ in names} & set(two)


def test_pii_genders_and_bare_mentions(spark, odd):
    texts = ["Mr. John Brown left. Brown and John came back; Browning did not.", "Mrs. Joan Brown", "IBAN DE88370400440532013000, call 1234567890, 555201334455"]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs_of(spark, texts), "k").collect()}
    _, he, name, *_ = got[0].split()
    assert got[0] == f"Mr. {he} {name} left. {name} and {he} came back; Browning did not."
    she = got[1].split()[1]
    assert got[1].split()[2] == name and she.endswith(("a", "elle")) and not he.endswith(("a", "elle"))
    assert got[2] == texts[2]
    kept = pii.pseudonymise(odd, "k")
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == dict(enumerate(ODD)) and kept.columns == [*odd.columns, "__kinds"]
    twice = pii.pseudonymise(docs_of(spark, ["SSN 123456789"] * 3), "k").collect()
    assert len(twice) == 3 and len({r["text"] for r in twice}) == 1


WHITE = ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", " ", "\x85", "\xa0", "\u1680", "\u180e", "\u2000", "\u2003", "\u200b", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\ufeff"]


def test_encoder_against_the_tokenizer():
    """100,000 strings rich in white space of all kinds, special tokens and marks."""
    rng = np.random.default_rng(5)
    bits = ["a", "Price", "10", "'s", "漢字", "é", "...", "-", "<|endoftext|>", "'", "x\u0301", "\U0001f600", " ", " ", " ", "  ", *WHITE]
    texts = ["".join(bits[i] for i in rng.integers(0, len(bits), rng.integers(1, 13))) for _ in range(100_000)]
    texts += ["a \xa0 \xa0 b", "Price \xa0 \xa0 \n10", "a \xa0 \xa0\n", ""]
    tokenizer, encoder = Tokenizer.from_file(packing.TOKENIZER), packing.Encoder(packing.TOKENIZER, packing.RANKS)
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want.ids


@pytest.mark.parametrize("n,most_open", [(300, 8192), (1000, 8192), (4000, 100)])
def test_levels_place_most_tokens(monkeypatch, n, most_open):
    monkeypatch.setattr(packing, "MAX_OPEN", most_open)
    sizes = np.random.default_rng(n).lognormal(6.4, 1.1, n).astype(int) + 1
    packer = packing.Packer(0)
    for i, size in enumerate(sizes):
        packer.add(i, np.full(size, i, "<u4").tobytes())
    packer.flush(True)
    fill, back = {}, {}
    for doc, start, ids, total, sequence, offset in packer.out:
        assert offset == fill.get(sequence, 0) and total == sizes[doc]
        fill[sequence] = offset + len(ids) // 4
        back.setdefault(doc, []).append((start, len(ids) // 4))
    assert all(n <= 1024 and (n == 1024 or n & (n - 1) == 0) for n in fill.values())
    for doc, pieces in back.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at == sizes[doc]
    assert most_open == 100 or 1 - packer.moved / packer.placed > 0.9


def test_packing_on_odd_rows(spark, odd):
    long_text = "word and another " * 30_000
    docs = odd.unionByName(docs_of(spark, [long_text]).withColumn("doc_id", F.lit(50).cast("long")))
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    own = {}
    for r in packing.pack(docs).collect():
        own.setdefault(r["doc_id"], []).append((r["start"], bytes(r["tokens"])))
    texts = {**dict(enumerate(ODD)), 50: long_text}
    for d, text in texts.items():
        ids = np.frombuffer(b"".join(t for _, t in sorted(own[d])), "<u4").tolist()
        assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_packing_round_trip(spark, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60").unionByName(
        spark.createDataFrame([(-1, None, None, None, 0), (-2, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    )
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    pieces, sequences = {}, {}
    for r in packing.pack(docs).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["tokens"])))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], len(r["tokens"]) // 4))
    for r in docs.collect():
        own = sorted(pieces[r["doc_id"]])
        assert [s for s, _ in own] == list(np.cumsum([0] + [len(t) // 4 for _, t in own[:-1]]))
        ids = np.frombuffer(b"".join(t for _, t in own), "<u4").tolist()
        assert ids == tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
    padded = 0
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own[:-1]]))
        n = sum(n for _, n in own)
        assert n <= 1024
        padded += 0 if n & (n - 1) == 0 else 1024 - n
    assert padded <= 0.01 * 1024 * len(sequences)
    assert packing.pack(none).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "\\### </turn>"), (1, 2, "user", None), (2, 0, None, ""), (3, 0, "assistant", "only")]
    made = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted((r["conv_id"], r["example"], r["last"], r["loss_length"] is not None) for r in made.collect())
    assert got == [(1, 0, False, True), (1, 1, True, False), (2, 0, True, False), (3, 0, True, True)]
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    assert back[1]["n_turns"] == 3 and back[1]["loss_chars"] == len("\\### </turn>")


def brute_nearest(vectors, k):
    ids = np.array([i for i, _ in vectors])
    data = np.array([v for _, v in vectors], np.float64)
    out = {}
    for i, v in vectors:
        if i % 20 == 0:
            s = data @ np.array(v, np.float64)
            s[ids == i] = -np.inf
            out[i] = {int(ids[j]) for j in np.lexsort((ids, -s))[:k]}
    return out


def test_neighbours(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    exact = brute_nearest([(r["vec_id"], r["embedding"]) for r in rows], 20)
    got = {}
    for r in neighbours.op1_projection_forest(spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(got) == set(exact)
    assert np.mean([len({v for _, v in got[q]} & exact[q]) / len(exact[q]) for q in exact]) >= 0.9
    nan = float("nan")
    bad = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [nan, 1.0]), (3, None), (20, [1.0, 0.0]), (4, [0.5, None])], "vec_id long, embedding array<float>")
    usable = neighbours.usable(bad)
    found = neighbours.search(usable, usable.filter("vec_id % 20 = 0")).collect()
    assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in found) == [(0, 20, 1), (20, 0, 1)]


@pytest.mark.parametrize("kind,touched", [("clusters", 0.2), ("none", 0.75), ("norms", 0.85)])
def test_forest_recall_and_work(spark, tmp_path, kind, touched):
    """20,000 vectors, clustered, without structure and of varied norms: recall, and the share of rows scored a query."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(0)
    data = rng.standard_normal((20_000, 64))
    if kind == "clusters":
        data = rng.standard_normal((200, 64))[rng.integers(0, 200, len(data))] + 0.3 * data
    data /= np.linalg.norm(data, axis=1)[:, None]
    if kind == "norms":
        data *= np.exp(rng.normal(0, 0.5, len(data)))[:, None]
    data = data.astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(data)), "embedding": pa.array(list(data), pa.list_(pa.float32()))}), str(tmp_path / "e.parquet"))
    vectors = neighbours.usable(spark.read.parquet(str(tmp_path / "e.parquet")))
    exact = brute_nearest(list(enumerate(data.astype(np.float64)))[::1], 20)
    got = {}
    for r in neighbours.search(vectors, vectors.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & exact[q]) / 20 for q in exact]) >= 0.9
    wide = data.astype(np.float64)
    norm = float(np.linalg.norm(wide, axis=1).max())
    forest = neighbours.Forest.fitted(wide, norm, neighbours.depth_for(len(wide), len(wide)))
    leaves, share = forest.leaves(neighbours.lifted(wide, norm)), []
    for q in wide[:2000:40]:
        seen = np.zeros(len(wide), bool)
        for t, leaf in forest.probe(np.append(q, 0.0), 21, 20)[0]:
            seen |= leaves[:, t] == leaf
        share.append(seen.mean())
    assert np.mean(share) < touched


def test_forest_on_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, tree int, leaf int, score double"
    search = lambda rows: sorted(
        (r["query_id"], r["rank"], r["vec_id"], r["score"])
        for v in [neighbours.usable(spark.createDataFrame([(*r, 1, 2, 0.5) for r in rows], schema))]
        for r in neighbours.search(v, v.filter("vec_id % 20 = 0"), k=2).collect()
    )
    assert search([]) == []
    same = [(i, [1.0, 0.0]) for i in (20, 40, 3, 4, 5, 20)] + [(60, [0.0, 2.0])]
    ties = [(20, 1, 3, 1.0), (20, 2, 4, 1.0), (40, 1, 3, 1.0), (40, 2, 4, 1.0), (60, 1, 3, 0.0), (60, 2, 4, 0.0)]
    assert search(same) == ties
    assert search([(0, [1.0, 1.0]), (1, [2.0]), (2, [-1.0, 0.5]), (None, [1.0, 0.0])]) == [(0, 1, 1, 2.0), (0, 2, 2, -0.5)]


def test_mixing_repeats_and_ties(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, "a b", "x"), (None, "a", "x"), (3, "one two three four", None), (3, "one two three four", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"taken": F.lit(1), "target": F.lit(2)})
    got = mixing.plan(docs).collect()
    assert len(got) == 6 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.plan(docs).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {1, 2, 3, None}


def test_chat_on_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, example long, loss string"
    made = lambda rows: chat.read_back(chat.examples(spark.createDataFrame([(*r, 1, "x") for r in rows], schema))).collect()
    assert made([]) == []
    rows = [(None, 0, "user", "a"), (None, None, "assistant", "b"), (5, 1, "assistant", "same"), (5, 1, "assistant", "same"), (6, 0, "a\nb", "")]
    got = {r["conv_id"]: r for r in made(rows)}
    assert {k: r["n_turns"] for k, r in got.items()} == {None: 2, 5: 2, 6: 1}
    assert got[5]["loss_chars"] == 8 and got[None]["loss_chars"] == 1 and got[6]["loss_chars"] == 0


def test_stages_on_odd_rows(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
        done = stage(spark, odd, SF)
        assert {r["doc_id"] for r in done.collect()} <= set(range(9)), name
        assert name == "packing" or done.columns == odd.columns, name
    assert corpus_pipeline.line_dedup(spark, odd, SF).count() == 9
    assert {r["doc_id"] for r in corpus_pipeline.packing_stage(spark, odd, SF).collect()} == set(range(9))


def test_pipeline_against_brute_force(spark, duck):
    """All stages again: SQL for the verdicts and the mix, loops for lines and near copies, the tokenizer for lengths."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    kept = {d for d, k in duck.execute(f"SELECT doc_id, kept FROM ({quality.quality_sql()})").fetchall() if k}
    rows = [r for r in docs.to_dict("records") if r["doc_id"] in kept]
    key = lambda line: line.strip(lines.BLANKS).translate(str.maketrans(lines.ascii_uppercase, lines.ascii_lowercase))
    seen = {}
    for r in rows:
        for k in {key(x) for x in r["text"].split("\n")} - {""}:
            seen[k] = seen.get(k, 0) + 1
    for r in rows:
        r["text"] = "\n".join(x for x in r["text"].split("\n") if seen.get(key(x), 0) < lines.THRESHOLD)
    words = [r["text"].encode().lower().split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    order = sorted(range(len(rows)), key=lambda i: rows[i]["doc_id"])
    root = {i: i for i in order}
    for x in order:
        for y in order:
            shared = len(sets[x] & sets[y])
            if y < x and 10 * shared >= 8 * (len(sets[x]) + len(sets[y]) - shared):
                a, b = root[x], root[y]
                root = {i: (b if r == a else r) for i, r in root.items()}
    best = {}
    for i in order:
        best.setdefault(root[i], i)
    import pandas as pd

    duck.register("kept_rows", pd.DataFrame([rows[i] for i in best.values()]))
    taken = duck.execute(f"SELECT doc_id, size, taken FROM ({mixing.plan_sql('kept_rows', whole=True)})").fetchall()
    times = {d: taken // size for d, size, taken in taken if size and taken // size}
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    text = {rows[i]["doc_id"]: rows[i]["text"] for i in best.values()}
    want = {d: n * (len(tokenizer.encode(text[d], add_special_tokens=False).ids) + 1) for d, n in times.items()}
    got = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum(F.expr("octet_length(tokens) div 4")).alias("n"))
    assert {r["doc_id"]: r["n"] for r in got.collect()} == want and len(want) > 50


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, SF)
    cut = corpus_pipeline.line_dedup(spark, good, SF)
    kept = corpus_pipeline.near_duplicates(spark, cut, SF)
    assert good.columns == cut.columns == kept.columns == docs.columns
    mixed = corpus_pipeline.source_mixing(spark, kept, SF)
    assert mixed.columns == docs.columns
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(copies.values()) <= 3
    tokens = {r["doc_id"]: r["n"] for r in corpus_pipeline.packing_stage(spark, mixed, SF).groupBy("doc_id").agg(F.sum(F.octet_length("tokens")).alias("n")).collect()}
    assert set(tokens) == set(copies)
