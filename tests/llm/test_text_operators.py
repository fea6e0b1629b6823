"""Near-duplicates, language, secrets, mixing, packing, sharding and the pipeline on whole texts."""

import random
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType
from tokenizers import Tokenizer

import corpus_pipeline
from freshet.llm import language, mixing, near_dedup, packing, secrets, sharding

from .conftest import prose

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def shingles(text):
    found = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4)))


def brute_components(rows):
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    names = sorted(sets)
    for n, a in enumerate(names):
        for b in names[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                up[high] = low
    return {i: (len(sets[i]), find(i)) for i in names}


def near(text, seed, share):
    rng, found = random.Random(seed), text.split()
    return " ".join(w if rng.random() > share else "x" + w for w in found)


def test_near_duplicates_match_brute_force(documents):
    rows = [(i, prose(i, 60)) for i in range(40)]
    base = prose(99, 300)
    # copies of very different distance: some link only through others, some not at all
    rows += [(100 + i, near(base, i, 0.012 * (i % 7))) for i in range(60)]
    rows += [(200 + i, near(rows[i][1], i, 0.01)) for i in range(20)] + [(300, "a b c"), (301, "A  b\tc"), (302, "a b"), (303, "")]
    df = documents([(i, t, "en", "s") for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_a_large_group_in_blocks(documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    base = prose(7, 120)
    rows = [(i, near(base, i, 0.004 * (i % 6))) for i in range(70)]
    df = documents([(i, t, "en", "s") for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_odd_rows(odd, nothing):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[4].component_id == 3 and not by[4].kept and by[8].component_id == 7
    assert by[1].n_shingles == by[2].n_shingles == by[6].n_shingles == 0 and by[1].kept and by[7].n_shingles == 1
    assert by[None].kept and by[None].component_id is None and by[0].n_shingles == len(shingles(odd.where("doc_id = 0").first().text))
    kept = near_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [0, 1, 2, 3, 5, 6, 7, 9, None]
    assert near_dedup.near_duplicates(nothing).count() == 0 and near_dedup.keep_first(nothing).count() == 0


def test_decisions_are_by_text_not_by_id(documents):
    a, b, c, d = (prose(i, 40) for i in (1, 2, 3, 4))
    rows = [(1, a), (1, b), (2, b), (None, c), (None, c), (5, c), (None, d), (None, d), (1, "")]
    df = documents([(i, t, "en", "s") for i, t in rows])
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in near_dedup.keep_first(df).collect())
    assert kept == sorted([(False, 1, a), (False, 1, b), (False, 5, c), (True, 0, d), (False, 1, "")])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=str)
    expected = [(1, 1, True), (1, 1, True), (2, 1, False), (None, 5, False), (None, 5, False), (5, 5, True), (None, None, True), (None, None, True), (1, 1, True)]
    assert got == sorted(expected, key=str)


def test_a_hot_id_stays_linear(documents, monkeypatch):
    """Texts that share an id are compared as texts: each reaches the confirming task once."""
    rows = [(7, prose(i, 25)) for i in range(400)] + [(8, prose(3, 25) + " more"), (9, prose(3, 25))]
    seen = documents([(i, t, "en", "s") for i, t in rows])
    counted = []
    meet = near_dedup.in_blocks

    def in_blocks(*args):
        out = meet(*args)
        counted.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "in_blocks", in_blocks)
    got = near_dedup.keep_first(seen).collect()
    assert len(got) == 400 and all(r.doc_id == 7 for r in got)
    # two texts are alike
    assert counted[-1] == 2


def test_letters_are_unicode_letters(documents):
    texts = ["\u00bd \u2461 \u00b3", "\u2167", "\u0661\u0662", "\u0301", "_ 1", "\u02b0", "\u4e2d", "\u01c5", "\u05d0", "x"]
    for text in texts:
        assert language.has_letter(text) == any(ch.isalpha() for ch in text)
    spark_side = documents([(i, t, "en", "s") for i, t in enumerate(texts)]).where(F.col("text").rlike(language._LETTER_SPARK))
    assert sorted(r.doc_id for r in spark_side.collect()) == [5, 6, 7, 8, 9]
    rows = [(i, prose(i, 30), "la", "s") for i in range(40)] + [(50, texts[0], None, "s"), (51, texts[1], None, "s")]
    found = {r.doc_id: r.lang_pred for r in language.identify(documents(rows)).collect()}
    assert found[50] == found[51] == "und" and found[0] == "la"


def test_language_learns_and_rejects(documents, odd, nothing):
    rows = [(i, prose(i, 30, "abcdefgh" if i % 2 else "stuvwxyz"), "la" if i % 2 else "zz", "s") for i in range(120)]
    got = language.identify(documents(rows)).collect()
    right = [r.lang_pred == ("la" if r.doc_id % 2 else "zz") for r in got]
    assert len(got) == 120 and sum(right) >= 118 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    found = {r.doc_id: r for r in language.identify(odd).collect()}
    assert [found[i].lang_pred for i in (1, 2, 5, 6)] == ["und"] * 4 and found[1].score == 0.0
    assert language.identify(nothing).count() == 0
    none = language.train(odd.withColumn("lang", F.lit(None).cast("string")))
    assert none.labels == [] and {r.doc_id for r in language.keep_identified(odd, none).collect()} == {0, 3, None, 4, 7, 8, 9}


def test_language_learns_beside_rows_without_id(documents, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 20)
    rows = [(None, prose(i, 30), "en", "s") for i in range(30)] + [(None, "12 34", "en", "s")] * 30
    rows += [(9, prose(900, 30, "qrstuvwxyz"), "de", "s")] * 30
    rows += [(i, prose(i, 30, "qrstuvwxyz"), "de", "s") for i in range(100, 140)]
    model = language.train(documents(rows))
    assert model.labels == ["de", "en"]
    assert model.predict(prose(7000, 30))[0] == "en" and model.predict(prose(7001, 30, "qrstuvwxyz"))[0] == "de"


def test_language_slices_do_not_change_the_counts(monkeypatch):
    text = prose(5, 400)
    whole = language.counts(text)
    monkeypatch.setattr(language, "SLICE", 97)
    cut = language.counts(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_secrets_found_and_masked(documents, odd, nothing):
    rng = random.Random(3)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, prose(i, 30) + " " + "".join(rng.choice("abcdefg") for _ in range(20)) + f" {rng.randint(10**15, 10**16)}", "en", "s") for i in range(30)]
    hidden = {}
    for i in range(30, 60):
        secret = [hexes(18), hexes(40), "AKIA" + "".join(rng.choice("ABCDEFGH234") for _ in range(16))][i % 3]
        lead = ["password=", 'token = "', ""][i % 3]
        hidden[i] = secret
        rows.append((i, f"{prose(i, 20)} {lead}{secret}{'"' if i % 3 == 1 else ''} {prose(i + 500, 20)} {lead}{secret}", "en", "s"))
    docs = documents(rows)
    found = [r for r in secrets.scan(docs).collect()]
    text = {i: t for i, t, _, _ in rows}
    assert all(text[r.doc_id][r.start : r.start + r.length] == r.value for r in found)
    told = defaultdict(set)
    for r in found:
        if r.is_secret:
            told[r.doc_id].add(r.value)
    assert told == {i: {s} for i, s in hidden.items()}
    clean = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert all(clean[i].text == t.replace(hidden.get(i, "\0"), secrets.MASK) and clean[i].n_chars == len(clean[i].text) for i, t in text.items())
    assert secrets.scan(odd).where("is_secret").count() == 0 and secrets.redact(odd).exceptAll(odd).count() == 0
    assert secrets.scan(nothing).count() == 0 and secrets.redact(nothing).count() == 0


def test_secrets_do_not_learn_words_from_candidates(documents):
    leaked = "qzxkvbnmlkj-trwpqsdfgh-1"
    rows = [(i, f"river gauge {prose(i, 5)} {leaked} end", "en", "s") for i in range(30)]
    rows += [(100 + i, "copied zanzibar text", "en", "s") for i in range(30)]
    known = {r.word for r in secrets.dictionary(documents(rows)).collect()}
    assert {"river", "gauge", "end"} <= known and not known & {"qzxkvbnmlkj", "trwpqsdfgh", "zanzibar", "copied"}


def test_secrets_features_cover_the_whole_value(documents):
    value = "A1" * 120 + "/alpha" * 60
    docs = documents([(0, f"x {value} y", "en", "s")])
    known = docs.select(F.lit("alpha").alias("word"))
    row = secrets.featured(secrets.findings(docs), known).first()
    assert row.value == value and row.covered == 300 / 600 and row.distinct == 7 / 600


def test_secrets_take_reviewed_labels(documents):
    docs = documents([(i, f"{prose(i, 5)} {'abcdefgh' * 3}{i} {prose(i, 5)} {'0123456789' * 2}{i}", "en", "s") for i in range(20)])
    labelled = secrets.findings(docs).select("key", "nth", (F.col("nth") == 0).cast("int").alias("label"))
    assert {(r.nth, r.is_secret) for r in secrets.scan(docs, labelled).collect()} == {(0, True), (1, False)}


def test_mixing_meets_its_targets(spark, documents, odd, nothing):
    rows = [(i, prose(i, 40, "abcdef" if i % 4 else "uvwxyz") + (" vile" if i % 4 == 0 else ""), "en", "s") for i in range(200)]
    labels = spark.createDataFrame([(i, "bad" if i % 4 == 0 else "fine") for i in range(100)] + [(None, "bad"), (3, None)], "doc_id long, domain string")
    docs = documents(rows)
    got = mixing.mix(docs, labels, {"bad": 0.5, "fine": 1.0}).collect()
    domains = ["bad", "fine"]
    for n, (d, weight) in enumerate(zip(domains, (0.5, 1.0), strict=True)):
        now = sum(r.tokens * r.posterior[n] for r in got)
        then = sum(r.tokens * r.posterior[n] * r.rate for r in got)
        assert abs(then - weight * now) < 0.02 * now, d
    assert all(r.rate >= 0 for r in got) and len(got) == 200
    kept = mixing.take(docs, labels, {"bad": 0.0})
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(200) if i % 4}
    assert mixing.mix(odd, labels, {}).count() == odd.count() and mixing.take(odd, labels, {}).count() == odd.count()
    assert mixing.mix(odd, labels.limit(0), {}).count() == odd.count() and mixing.mix(nothing, labels, {}).count() == 0


@pytest.mark.parametrize("blur", [0.0, 1e-5])
def test_mixing_meets_the_target_of_a_rare_domain(spark, blur):
    rows = [(100, [1 - blur, blur] if i else [blur, 1 - blur]) for i in range(1000)]
    table = spark.createDataFrame(rows, "tokens long, posterior array<double>").coalesce(4)
    pulls = mixing.fit_rates(table, ["many", "rare"], {"rare": 0.0})
    got = table.withColumn("rate", mixing.rate(F.col("posterior"), pulls)).collect()
    for n, aim in enumerate((1.0, 0.0)):
        now = sum(r.tokens * r.posterior[n] for r in got)
        assert abs(sum(r.tokens * r.posterior[n] * r.rate for r in got) - aim * now) <= mixing.TOLERANCE * now
    assert max(r.rate for r in got if r.posterior[1] > 0.5) < 0.05


@pytest.mark.parametrize("size", [600, 1800])
def test_taken_totals_come_near_the_targets(spark, documents, size):
    rng = random.Random(size)
    kinds = ["good"] * 6 + ["poor"] * 3 + ["toxic"]
    rows, labels = [], []
    for i in range(size):
        kind = rng.choice(kinds)
        stock = {"good": "abcdef", "poor": "cdefgh", "toxic": "uvwxyz"}[kind]
        rows.append((i, prose(i, rng.randint(20, 60), stock), "en", "s"))
        if i % 3 == 0:
            labels.append((i, kind))
    wanted = {"good": 1.0, "poor": 1.0, "toxic": 0.0}
    table = spark.createDataFrame(labels, "doc_id long, domain string")
    for r in mixing.totals(documents(rows), table, wanted).collect():
        # soft memberships leave a part of the unwanted domain in every row that stays
        assert abs(r.fitted - r.target) <= 2 * mixing.TOLERANCE * r.present, r
        assert abs(r.taken - r.target) <= 2 * mixing.TOLERANCE * r.present, r


def test_labels_that_contradict_each_other_and_hot_ids(spark, documents):
    rows = [(i, prose(i, 30, "abcdef" if i % 2 else "uvwxyz"), "en", "s") for i in range(60)]
    # one id with very many texts, and labels of two domains for another
    rows += [(500, prose(1000 + i, 10, "mnop"), "en", "s") for i in range(200)]
    labels = [(i, "a" if i % 2 else "b") for i in range(60)] + [(500, "a"), (7, "b")]
    model, domains = mixing.train(documents(rows), spark.createDataFrame(labels, "doc_id long, domain string"), sample=30)
    assert domains == ["a", "b"]
    for _ in range(2):
        again, _ = mixing.train(documents(rows), spark.createDataFrame(labels[::-1], "doc_id long, domain string"), sample=30)
        assert (again.coefficientMatrix.toArray() == model.coefficientMatrix.toArray()).all()


def test_mixing_says_which_target_cannot_be_met(spark):
    table = spark.createDataFrame([(100, [0.9, 0.1])] * 20, "tokens long, posterior array<double>").coalesce(4)
    with pytest.warns(UserWarning, match="'b'"):
        mixing.fit_rates(table, ["a", "b"], {"b": 0.0})


def check_packing(rows, packed, limit):
    """An exact round trip of every piece; returns the number of sequences."""
    tokens = Tokenizer.from_file(JSON)
    tokens.encode_special_tokens = True
    want = []
    for i, text in rows:
        ids = [*tokens.encode((text or ""), add_special_tokens=False).ids, 0]
        first = len(ids) % limit or limit
        starts = [0, *range(first, len(ids), limit)]
        for n, s in enumerate(starts):
            part = ids[s : first if n == 0 else s + limit]
            want.append((i, n, s, len(part), zlib.crc32(b"".join(v.to_bytes(4, "little") for v in part))))
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=key) == sorted(want, key=key)
    held = defaultdict(list)
    for r in packed:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= limit
    return len(held), sum(r[3] for r in want)


def test_packing_round_trip(documents, odd, nothing):
    rng = random.Random(4)
    rows = [(i, prose(i, rng.choice([3, 20, 60, 150, 900]))) for i in range(150)]
    packed = packing.pack(packing.pieces(documents([(i, t, "en", "s") for i, t in rows]), JSON, RANKS, 512), 512).collect()
    sequences, total = check_packing(rows, packed, 512)
    assert sequences <= -(-total // 512) + 2
    packed = packing.pack(packing.pieces(odd, JSON, RANKS)).collect()
    check_packing([(r.doc_id, r.text) for r in odd.collect()], packed, 2048)
    assert packing.pack(packing.pieces(nothing, JSON, RANKS)).count() == 0


def test_packing_returns_the_tokens(documents):
    texts = {i: prose(i, 20 + 30 * i) for i in range(30)}
    packed = packing.pack(packing.pieces(documents([(i, t, "en", "s") for i, t in texts.items()]), JSON, RANKS, 128), 128)
    rows = sorted(packed.collect(), key=lambda r: (r.doc_id, r.piece))
    for i, text in texts.items():
        assert [v for r in rows if r.doc_id == i for v in r.ids] == packing.encode(text, JSON, RANKS).tolist()
    assert all(len(r.ids) == r.length for r in rows)
    digests = packing.digested(packed).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(map(tuple, digests)) == [(r.doc_id, r.piece, r.ids_crc32) for r in rows]


def test_packing_over_several_shards(documents, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 16)
    rows = [(i, prose(i, 10 + i)) for i in range(100)]
    packed = packing.pack(packing.pieces(documents([(i, t, "en", "s") for i, t in rows]), JSON, RANKS, 512), 512).collect()
    sequences, total = check_packing(rows, packed, 512)
    assert sequences <= 1.1 * total / 512 + 2


def test_both_tokenizers_agree(spark):
    tokens = Tokenizer.from_file(JSON)
    tokens.encode_special_tokens = True
    for text in ("it's we'll 'd  x\n\n y\t z  ", " 's", "café ř² 12a<|endoftext|>", "a b ­", "中文 \x1c \x85", "", "'ll've"):
        assert packing.encode(text, JSON, RANKS).tolist() == [*tokens.encode(text, add_special_tokens=False).ids, 0]


def test_strings_of_special_tokens_by_either_rule():
    plain = Tokenizer.from_file(JSON)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "a <|endoftext| b"):
        ids = packing.encode(text, JSON, RANKS, special_as_text=False).tolist()
        assert ids == [*plain.encode(text, add_special_tokens=False).ids, 0]
    assert 50256 not in packing.encode("a <|endoftext|> b", JSON, RANKS).tolist()


def test_crossover_keeps_every_item():
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(1))
    sizes = rng.integers(1, 100, 300)
    a, b = (packing.first_packing(sizes, 100, rng, n) for n in (0.0, 0.5))
    for _ in range(20):
        a = packing.crossover(a, b, sizes, 100, rng)
        assert (a.room >= 0).all() and (np.bincount(a.bin, sizes) + a.room == 100).all()


def test_shards_fit(documents, odd, nothing):
    rows = [(i % 150 if i < 170 else 1000, "x" * (i % 90), "en", "s") for i in range(260)]
    docs = documents(rows)
    got = sharding.shards(docs, "doc_id", F.octet_length("text"), 400).collect()
    assert len(got) == 260 and {r.key for r in got} == {"k"}
    held, ids, whole = defaultdict(int), defaultdict(set), defaultdict(int)
    for r in got:
        whole[r.depth, r.prefix] += len(r.text)
        held[r.depth, r.prefix, r.part] += len(r.text)
        ids[r.depth, r.prefix].add(r.doc_id)
    assert all(r.shard_bytes == whole[r.depth, r.prefix] for r in got)
    # only the shard of one repeated key may be over the limit, and its parts are not by more than a row
    assert all(n <= 400 or len(ids[k]) == 1 for k, n in whole.items()) and all(n < 400 + 90 for n in held.values())
    # prefixes don't overlap, and no bucket was split without need
    bits = sorted(f"{p:0{d}b}" if d else "" for d, p in whole)
    assert not any(b.startswith(a) for a, b in zip(bits, bits[1:], strict=False))
    for d, p in whole:
        up = sum(n for (e, q), n in whole.items() if d and e >= d and q >> (e - d) >> 1 == p >> 1)
        assert not d or up > 400
    assert sharding.shards(odd, "doc_id", F.octet_length("text"), 1000).count() == odd.count()
    assert sharding.shards(nothing, "doc_id", F.octet_length("text"), 1000).count() == 0


def test_parts_of_a_hot_id_fit(documents):
    rows = [(7, "x" * 60, "en", "s")] * 30 + [(None, "y" * 70, "en", "s")] * 10 + [(8, "z" * 300, "en", "s"), (7, None, "en", "s")]
    rows += [(7, "x" * 250, "en", "s")] * 2 + [(i, "a" * 9, "en", "s") for i in range(100, 150)]
    got = sharding.shards(documents(rows), "doc_id", F.octet_length("text"), 100).collect()
    assert len(got) == len(rows)
    held = defaultdict(list)
    for r in got:
        held[r.depth, r.prefix, r.part].append(r)
    for own in held.values():
        sizes = [len(r.text or "") for r in own]
        assert sum(sizes) <= 100 or len(sizes) == 1
        assert {r.part_bytes for r in own} == {sum(sizes)}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_tables(spark, odd, nothing, tmp_path, name, stage):
    spark.createDataFrame([(3, 1, 0), (4, 0, 1), (7, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, nothing):
        out = stage(spark, docs, str(tmp_path))
        assert (out.count() > 0) == (docs is odd)
        if name != "best_fit_packing":
            assert out.count() <= docs.count() and out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert any(isinstance(f.dataType, (LongType, StringType)) for f in out.schema)


def test_pipeline_against_planted_cases(spark, tmp_path):
    rows, labels = [], []
    for i in range(120):
        text = prose(i, 60, "abcdefgh" if i % 2 else "stuvwxyz")
        toxic = i % 5 == 0
        rows.append((i, text + (" vile" * 2 if toxic else ""), "la" if i % 2 else "zz", "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(200, rows[1][1], "la", "s"), (201, near(rows[2][1], 1, 0.01), "zz", "s"), (202, "1 2 3", "la", "s"), (203, prose(900, 40, "abcdefgh") + " password=0a1b2c3d4e5f607182", "la", "s")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, len(r[1])) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {i for i in range(120) if i % 5} | {203}
    tokens = Tokenizer.from_file(JSON)
    masked = tokens.encode(rows[-1][1].replace("0a1b2c3d4e5f607182", secrets.MASK), add_special_tokens=False).ids
    assert next(r.length for r in out if r.doc_id == 203) == len(masked) + 1
