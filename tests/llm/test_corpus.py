"""Corpus operators against SQL, brute force, round trips and held-out accuracy, with the odd inputs that they define."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from caseloom.llm import chat_format, common, components, decontamination, language_id, mixing, near_dedup, quality_rules, queries, sharding, substring_dedup, token_counts, warc

DATA = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, very long, repeated and tied rows, and columns whose names the operators use inside."""
    base = " ".join(f"word{i}" for i in range(80))
    texts = [None, "", " \n\t ", "one two", "one two", base, base, base.replace("word3 ", "other "), "ab " * 30_000, "x" * 200_000, base + "\n" + base.upper()]
    data = [(i, t, ["en", None][i % 2], [None, "a", "b"][i % 3], 0) for i, t in enumerate(texts)]
    data += [data[5], (None, base, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(data, DOC_SCHEMA)
    for c in ("text_key", "size", "copies", "row", "slot_id", "shard", "spans", "place", "set_key", "line", "id", "target"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLE_SQL[name])


# sharding


def brute_map(totals, n):
    loads, at = [0] * n, {}
    for size, slot in sorted((-b, s) for s, b in totals.items()):
        to = loads.index(min(loads))
        loads[to] -= size
        at[slot] = to
    return at, loads


def test_shards_follow_the_greedy_map(spark):
    placed = queries.op1_sharding(spark, DATA).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    totals = defaultdict(int)
    for r in placed:
        data = texts[r["doc_id"]].encode()
        assert r["size"] == len(data) + 16 and r["text_crc32"] == zlib.crc32(data)
        totals[r["virtual_slot"]] += r["size"]
    at, _ = brute_map(totals, 40)
    assert all(r["shard"] == at[r["virtual_slot"]] for r in placed)
    by = defaultdict(list)
    for r in placed:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_are_even(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 300).cast("int")).alias("text"))
    sizes = [r["s"] for r in sharding.shard_documents(docs, 40).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 40 and max(sizes) < 1.01 * sum(sizes) / 40


def test_repeated_rows_are_spread(spark, same_rows):
    """A third of the rows are one row; the law holds, and the SQL gives the same rows."""
    own = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.lit(100)).alias("text"))
    docs = own.union(spark.range(10_000).select(F.lit(None).cast("long"), F.lit("one text of all these rows"))).union(own.limit(3))
    placed = sharding.shard_documents(docs, 40)
    by = placed.groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("d")).collect()
    mean = sum(r["s"] for r in by) / 40
    assert len(by) == 40 and max(r["s"] for r in by) < 1.01 * mean and min(r["s"] for r in by) > 0.99 * mean
    assert sum(r["n"] for r in by) == docs.count() and all((r["low"], r["high"], r["d"]) == (0, r["n"] - 1, r["n"]) for r in by)
    few = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text")).union(docs.where("doc_id IS NULL").limit(1000))
    columns = ["doc_id", "size", "text_crc32", "shard", "slot", F.col("slot_id").alias("virtual_slot"), F.col("version").alias("map_version")]
    got = sharding.shard_documents(few, 40).select(*columns, F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))
    same_rows(got, queries.ORACLE_SQL["op1_sharding"], documents=few)


def test_copies_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    docs = spark.createDataFrame([(1, "a")] * 50 + [(None, None)] * 7 + [(2, "b")], "id long, copies string").withColumn("slot_id", F.lit("clash"))
    got = sharding.document_records(docs, id_col="id", text_col="copies")
    assert got.columns == ["id", "size", "text_crc32", "slot_id"]
    assert {r["id"]: (r["n"], r["s"]) for r in got.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("slot_id").alias("s")).collect()} == {1: (50, 50), None: (7, 7), 2: (1, 1)}


def test_map_versions(spark, tmp_path):
    totals = spark.range(500).select(F.col("id").cast("int").alias("slot_id"), (F.col("id") * 37 % 101 + 1).alias("slot_bytes"), F.lit(1).cast("long").alias("slot_rows"))
    first = sharding.build_map(totals, 8)
    second = sharding.add_shard(first)
    before, after = ({r["slot_id"]: r["shard"] for r in m.collect()} for m in (first, second))
    assert set(before) == set(after) and all(after[s] in (before[s], 8) for s in before)
    load = defaultdict(int)
    for r in second.collect():
        load[r["shard"]] += r["slot_bytes"]
    assert max(load.values()) < 1.15 * sum(load.values()) / 9 and load[8] > 0.8 * sum(load.values()) / 9
    for m in (first, second):
        sharding.save_map(m, str(tmp_path / "map"))
        sharding.save_map(m, str(tmp_path / "map"))
    assert sharding.load_map(spark, str(tmp_path / "map")).first()["version"] == 2
    assert {r["slot_id"]: r["shard"] for r in sharding.load_map(spark, str(tmp_path / "map"), 1).collect()} == before


def test_sharding_odd_input(odd, empty):
    assert sharding.shard_documents(odd, 3).count() == odd.count()
    assert sharding.shard_documents(empty, 3).count() == 0


# mixing


def test_water_filling_matches_the_loop(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 80, None: 40}
    totals = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(totals, [3, 1, 2], 1.5, 2.0).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1], strict=True))
    stop, free, left, want = {k: 2.0 * v for k, v in sizes.items()}, set(sizes), 1.5 * sum(sizes.values()), {}
    while True:
        level = left / sum(weight[k] for k in free)
        over = {k for k in free if weight[k] * level > stop[k]}
        if not over:
            break
        for k in over:
            want[k], left = stop[k], left - stop[k]
        free -= over
    want |= {k: weight[k] * level for k in free}
    assert got == pytest.approx(want)


def test_mix_reaches_its_targets(odd, empty):
    got = mixing.mix(odd, [3, 1, 2]).collect()
    assert len(got) == odd.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[k] - target[k]) <= 1 for k in target)
    assert rows(mixing.mix(odd.repartition(3), [3, 1, 2])) == sorted(map(tuple, got), key=repr)
    assert mixing.mix(empty, [3, 1, 2]).count() == 0


# near duplicates


def brute_components(texts):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else set() for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_crowded_group_keeps_every_link(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    texts = {0: " ".join(base)}
    for i in range(1, 160):
        words = list(base)
        for at in r.sample(range(200), 5):
            words[at] = f"n{r.randrange(10**6)}"
        texts[i] = " ".join(words)
    texts[200], texts[201] = "short text", "SHORT  text"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_components(texts)


def test_dense_region_keeps_planted_links(spark):
    r = random.Random(11)
    words = lambda n: [f"o{r.randrange(10**9)}" for _ in range(n)]
    passage, texts = words(245), {}
    for i in range(300):
        own = words(55)
        texts[i] = passage + own  # 241 of 351 shingles are those of any other: 0.69
        if i < 100:
            texts[5000 + i] = passage + own[:16] + words(39)  # near 0.77 to its like, 0.69 to all others
    a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (texts[0], texts[5000]))
    assert 0.75 < len(a & b) / len(a | b) < 0.78
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: i % 5000 for i in texts}


def test_subgroups_of_a_template_are_not_paired(spark, monkeypatch):
    """Two subgroups around one template, every text below the border from every other but for planted links: what is joined grows with the texts, not with their square."""
    plain, joined, levels = near_dedup.stash, {}, {}

    def counted(df, name):
        kept = plain(df, name)
        if name == "paired":
            joined[n] = joined.get(n, 0) + (kept.groupBy("place").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0)
            levels[n] = levels.get(n, 0) + 1
        return kept

    monkeypatch.setattr(near_dedup, "stash", counted)
    r = random.Random(17)
    words = lambda k: [f"g{r.randrange(10**9)}" for _ in range(k)]
    template, groups = words(130), [words(60), words(60)]
    for n in (400, 1600):
        texts = {i: template + groups[i % 2] + words(60) for i in range(n)}
        for i in range(10):
            texts[10_000 + i] = texts[i][:-12] + words(12)  # 0.9 to its like
        docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(4)
        got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(docs).collect()}
        assert got == {i: i % 10_000 for i in texts}
    assert max(joined[n] / n for n in joined) < 2000, "a bound for each text, however many there are"
    assert levels[1600] == 2


def test_levels_do_not_change_components(spark, monkeypatch):
    """Texts with any of a few common edits, crowded at every level; a small bound makes many levels."""
    monkeypatch.setattr(near_dedup, "CROWD", 3)
    r = random.Random(37)
    new = lambda n: [f"n{r.randrange(10**9)}" for _ in range(n)]
    base, edits = new(150), [(10 * k, new(6)) for k in range(12)]
    texts = {}
    for doc in range(150):
        words = list(base)
        for at, edit in r.sample(edits, r.randrange(2, 8)):
            words[at : at + 6] = edit
        texts[doc] = " ".join(words + new(r.choice([4, 12, 20])))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = brute_components(texts)
    for levels in (1, 2, 6):
        monkeypatch.setattr(near_dedup, "LEVELS", levels)
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.near_duplicates(docs).collect()}
        assert got == want and 3 < len({c for _, c in want.values()}) < len(want)


@pytest.mark.parametrize("partitions", [1, 4, 200])
def test_components_do_not_depend_on_partitions(spark, partitions):
    """Crowds at every similarity around the border, some of them with edits in common."""
    r = random.Random(29)
    new = lambda n: [f"n{r.randrange(10**9)}" for _ in range(n)]
    texts, doc = {}, 0
    for _ in range(3):
        base, edits = new(120), [(r.randrange(120), new(1)) for _ in range(12)]
        for _ in range(70):
            words = list(base)
            for at in r.sample(range(120), r.randrange(0, 7)):
                words[at : at + 1] = new(r.choice([0, 1, 1, 2]))
            for at, word in r.sample(edits, r.randrange(0, 4)):
                words[min(at, len(words) - 1)] = word[0]
            texts[doc] = " ".join(words + new(r.choice([0, 0, 25])))
            doc += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.near_duplicates(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute_components(texts)
    assert got == want and 3 < len({c for _, c in want.values()}) < len(want)


def test_lookups_meet_every_linked_pair():
    """Two linked members that need share differences look up more than either has apart, so that one that both have is among the first of both."""
    r = np.random.default_rng(3)
    seen = 0
    while seen < 3000:
        hub = int(r.integers(1, 300))
        own, gone = r.integers(0, 60, 2), r.integers(0, min(hub, 60), 2)
        shared = int(r.integers(0, own.min() + 1)) + int(r.integers(0, gone.min() + 1))
        sizes, apart = hub - gone + own, own + gone
        linked = sizes.min() > 0 and 175 * (apart.sum() - 2 * shared) <= 25 * sizes.sum()
        if not linked or 175 * apart.sum() <= 25 * sizes.sum():  # linked whatever they share
            continue
        seen += 1
        assert shared > 0
        for x in (0, 1):
            assert near_dedup.lookups(int(apart[x]), int(sizes[x]), hub) >= apart[x] - shared + 1


def test_near_duplicates_odd_input(odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[0]["n_shingles"] == 0 and by[0]["kept"] and by[1]["component_id"] == 1
    assert by[4]["component_id"] == 3 and by[6]["component_id"] == 5 and by[7]["component_id"] == 5
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.connected_components(edges.union(spark.createDataFrame([(500, 501), (501, 501)], "a long, b long")))
    assert rows(got) == sorted([(i, 1) for i in range(2, 301)] + [(501, 500)], key=repr)


# language


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) > 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_predictions_equal_a_plain_loop(spark):
    """Each text compressed by itself, piece after piece, with each dictionary: the fewest bytes win, ties by name."""
    import zstandard

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    learned = docs.where("lang IS NOT NULL").where(~language_id.held_out(F.col("doc_id")))
    content = language_id.dictionaries(language_id.sample(learned.select("doc_id", "text", "lang")))
    assert set(content) == {r["lang"] for r in learned.select("lang").distinct().collect()}
    want = {}
    for r in docs.collect():
        text, sizes = r["text"] or "", {}
        for lang, data in content.items():
            pack = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
            low = text.lower().encode()
            sizes[lang] = sum(len(pack.compress(low[i : i + 8192])) for i in range(0, len(low), 8192))
        best = min(sizes, key=lambda x: (sizes[x], x))
        second = min(v for k, v in sizes.items() if k != best)
        want[r["doc_id"]] = (best, round(1 - sizes[best] / second, 9)) if any(c.isalpha() for c in text) else ("und", 0.0)
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(docs).collect()}
    assert got == want


def test_a_language_of_long_texts_is_learned(spark):
    r = random.Random(4)
    spell = lambda letters: ["".join(r.choice(letters) for _ in range(r.randrange(3, 9))) for _ in range(400)]
    some, other = spell("aeiouñrst"), spell("eaoyhkwtn")
    say = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    data = [(i, say(some, 6000), "es") for i in range(8)] + [(10 + i, say(other, 300), "en") for i in range(8)] + [(20, say(some, 60), None), (21, "x", "zz"), (22, "y", "zz"), (23, "y", "zz")]
    got = {x["doc_id"]: x["lang_pred"] for x in language_id.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert got[20] == "es" and all(got[i] == "es" for i in range(8)) and all(got[i] == "en" for i in range(10, 18))


def test_language_odd_input(odd, empty):
    got = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2))
    assert {r["lang_pred"] for r in got.values()} <= {"und", "en"}
    assert language_id.identify(empty).count() == 0


# archives


def test_archives_round_trip(spark, tmp_path):
    big = "é" * 700 + "\r\n\r\n" + "z" * 400
    data = [(1, "http://a/1", "small"), (2, "http://a/2", "small"), (3, None, big), (4, "http://a/4", big), (5, "x\r\ny", None), (6, "", ""), (None, "n", big), (3, "again", big)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = warc.archive_pages(pages, str(tmp_path / "w")).collect()
    kinds = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got), key=repr)
    assert kinds == sorted([(0, "revisit", 4), (1, "response", None), (2, "response", None), (3, "revisit", 4), (3, "revisit", 4), (4, "response", None), (5, "response", None), (6, "response", None)], key=repr)
    assert {r["payload_bytes"] for r in got if r["page_id"] in (3, 4)} == {len(big.encode())} and len({r["payload_digest"] for r in got if r["page_id"] in (3, 4)}) == 1
    stored = spark.read.format("warc").load(str(tmp_path / "w"))
    assert bytes(stored.where("record_id = 'urn:page:4'").first()["payload"]) == big.encode()
    assert warc.archive_pages(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_archive_files_are_plain_gzip(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(i, "u", "p" * i) for i in range(50)], "page_id long, url string, html string")
    warc.register(spark)
    warc.page_records(pages).coalesce(1).write.format("warc").option("fileBytes", "4000").mode("append").save(str(tmp_path / "w"))
    files = list((tmp_path / "w").glob("*.warc.gz"))
    assert len(files) > 1 and sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in files) == 50
    foreign = tmp_path / "f"
    foreign.mkdir()
    (foreign / "a.warc.gz").write_bytes(b"".join(gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <r%d>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" % i) for i in range(3)))
    read = spark.read.format("warc").load(str(foreign))
    assert [(r["record_id"], bytes(r["payload"])) for r in read.orderBy("record_id").collect()] == [(f"r{i}", b"abc") for i in range(3)]
    assert spark.read.format("warc").option("payload", "false").load(str(foreign)).where("record_id = 'r1'").count() == 1


class _CountedFiles:
    """The local file system, with the bytes that are read of its files."""

    def __init__(self, fs):
        self.fs, self.read = fs, 0

    def __getattr__(self, name):
        return getattr(self.fs, name)

    def open_input_file(self, path):
        return _CountedFile(self, self.fs.open_input_file(path))


class _CountedFile:
    def __init__(self, files, file):
        self.files, self.file = files, file

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def __getattr__(self, name):
        return getattr(self.file, name)

    def read(self, n=None):
        data = self.file.read(n)
        self.files.read += len(data)
        return data


def test_archives_are_read_once(spark, tmp_path, monkeypatch):
    r = random.Random(6)
    noise = lambda n: "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(n))  # noqa: E731  packs badly
    plain = warc._file_system
    for folder, pages in (("small", [(i, "u", noise(300)) for i in range(1000)]), ("large", [(i, "u", noise(150_000 if i % 2 else 10)) for i in range(30)])):
        path = str(tmp_path / folder)
        warc.register(spark)
        warc.page_records(spark.createDataFrame(pages, "page_id long, url string, html string")).coalesce(1).write.format("warc").mode("append").save(path)
        archive = sum(f.stat().st_size for f in (tmp_path / folder).glob("*.warc.gz"))
        for payload in (True, False):
            files = _CountedFiles(plain(path)[0])
            monkeypatch.setattr(warc, "_file_system", lambda p, files=files: (files, p))
            reader = warc.WarcReader(path, payload, 1 << 30)
            (part,) = reader.partitions()
            files.read = 0
            rows = [row for batch in reader.read(part) for row in batch.to_pylist()]
            assert {x["record_id"]: x["payload"] for x in rows} == {f"urn:page:{i}": t.encode() if payload else None for i, _, t in pages}
            assert files.read <= (1.1 if payload or folder == "small" else 0.4) * archive
        monkeypatch.setattr(warc, "_file_system", plain)


# tokens


@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece.SentencePieceProcessor(model_file=path), path


def test_token_counts_equal_the_library(spark, model):
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op6_token_counts(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert got == {r["doc_id"]: len(model[0].encode(r["text"] or "")) for r in docs}


def test_token_counts_of_hostile_texts(model):
    counter, r = token_counts.load_counter(model[1]), random.Random(5)
    alphabet = list("  \n\tabcdethe▁éß漢한😀<s>/[]0129.,ABC")
    for _ in range(1500):
        text = "".join(r.choice(alphabet) * r.choice([1, 1, 1, 2, 9]) for _ in range(r.randrange(40)))
        want = len(model[0].encode(text))
        assert all(token_counts.count_tokens(text, counter, chunk) == want for chunk in (5, 16, 65_536)), text


def test_token_counts_odd_input(odd, empty, model):
    got = {r["doc_id"]: r for r in token_counts.tokens(odd, model[1]).collect()}
    assert got[0]["n_tokens"] == got[1]["n_tokens"] == 0 and got[9]["n_tokens"] == len(model[0].encode("x" * 200_000))
    assert token_counts.tokens(empty, model[1]).count() == 0


# quality


def test_boilerplate_depletes(spark):
    letters = lambda i: "".join(chr(97 + (i // 26**k) % 26) for k in range(3))  # noqa: E731  digits are alike
    own = lambda i, n: " ".join(f"d{letters(i)}x{letters(k)}" for k in range(n))
    common_line = " ".join(f"menu{letters(k)}" for k in range(40))
    data = [(i, own(i, 30) + "\n" + common_line, "h") for i in range(60)] + [(100 + i, own(i, 90) + "\n" + common_line, "h") for i in range(20)]
    data += [(200 + i, " ".join(f"same{letters(k)}" for k in range(80)), "h") for i in range(50)]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert not any(got[i]["kept"] for i in range(60)) and all(got[100 + i]["kept"] for i in range(20))
    assert all(got[200 + i]["kept"] for i in range(50)), "copies of one text are no boilerplate"


def test_two_common_lines_and_a_large_host(spark):
    letters = lambda i: "".join(chr(97 + (i // 26**k) % 26) for k in range(3))
    own = lambda i, n: " ".join(f"d{letters(i)}x{letters(k)}" for k in range(n))
    menu, foot = (" ".join(f"{w}{letters(k)}" for k in range(40)) for w in ("menu", "foot"))
    data = [(i, f"{menu}\n{own(i, 15)}\n{foot}", "two") for i in range(60)]
    data += [(1000 + i, f"{own(i, 30)}\n{menu if i < 30 else own(9000 + i, 40)}", "large") for i in range(2100)]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert all(got[i]["removed_words"] == 80 and not got[i]["kept"] for i in range(60))
    assert all(got[1000 + i]["removed_words"] == (40 if i < 30 else 0) for i in range(2100)), "30 of 2,100 documents are above 1 %"


def test_quality_odd_input(odd, empty):
    got = quality_rules.judge(odd).collect()
    assert len(got) == odd.count() and all(r["base_failed"] for r in got if r["doc_id"] in (0, 1, 2, 3, 8, 9))
    assert quality_rules.judge(empty).count() == 0


# chat


def test_chat_keeps_hostile_turns(spark):
    data = [(1, 0, "user", "<s>a&lt;b"), (1, 1, "user", None), (1, 2, "assistant", "[x]</s>"), (1, 3, "assistant", "<sep>\n"), (2, 0, None, "&amp;"), (1, 3, "assistant", "<sep>\n")]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    made = chat_format.format_conversations(turns)
    back = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in made.select("conv_id", chat_format.turns_of(F.col("formatted")).alias("t")).collect()}
    assert back == {1: [("user", "<s>a&lt;b"), ("user", ""), ("assistant", "[x]</s>"), ("assistant", "<sep>\n"), ("assistant", "<sep>\n")], 2: [("", "&amp;")]}
    loss = {r[0]: r[1] for r in made.select("conv_id", chat_format.trained_text(F.col("formatted"), F.col("loss_mask"))).collect()}
    assert loss == {1: "[x]</s><sep>\n<sep>\n", 2: ""}
    assert chat_format.digests(chat_format.format_conversations(turns.limit(0))).count() == 0


def test_chat_reads_long_conversations_by_the_mask(spark):
    """More runs than a block and texts longer than a chunk, whose characters take one to four bytes."""
    r = random.Random(12)
    said = {c: [(r.choice(["user", "assistant"]), "".join(r.choices("a <[&é漢😀\n", k=r.choice([0, 1, 7, 1023, 1024, 3000])))) for _ in range(n)] for c, n in ((1, 1), (2, 85), (3, 86), (4, 900))}
    turns = spark.createDataFrame([(c, i, role, text) for c, t in said.items() for i, (role, text) in enumerate(t)], "conv_id long, turn long, role string, text string")
    made = chat_format.format_conversations(turns)
    loss = {x[0]: x[1] for x in made.select("conv_id", chat_format.trained_text(F.col("formatted"), F.col("loss_mask"))).collect()}
    assert loss == {c: "".join(text for role, text in t if role == "assistant") for c, t in said.items()}
    no_runs = made.select("formatted", F.filter("loss_mask", lambda run: run["chars"] < 0).alias("loss_mask"))
    assert {x[0] for x in no_runs.select(chat_format.trained_text(F.col("formatted"), F.col("loss_mask"))).collect()} == {""}


# decontamination


def test_sketch_cannot_miss():
    for n in range(1, 300):
        missing = n - -(-n * decontamination.CONTAINED_PERCENT // 100)
        assert decontamination.sketch_size(n) > missing or decontamination.sketch_size(n) == n


def test_contained_items(spark):
    r = random.Random(9)
    words = lambda n: [f"t{r.randrange(10**6)}" for _ in range(n)]
    items = {i: words(r.randrange(1, 60)) for i in range(40)}
    docs = {}
    for d in range(60):
        body, item = words(r.randrange(0, 3000)), list(items[r.randrange(40)])
        for _ in range(d % 3):
            item[r.randrange(len(item))] = "changed"
        docs[d] = " ".join(body + item + words(5)).upper()
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    want = set()
    for d, text in docs.items():
        w = text.lower().split()
        for i, item in items.items():
            own = grams(item, min(5, len(item)))
            if 100 * len(own & grams(w, min(5, len(item)))) >= 75 * len(own):
                want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(99, None), (98, "")], "item_id long, text string")
    table = spark.createDataFrame(list(docs.items()) + [(100, None)], "doc_id long, text string").withColumn("n_item", F.lit("clash"))
    got = decontamination.contained_items(table, bench, least_words=1)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    # by default items of under a shingle are left out and listed; repeated rows of both tables give their rows
    long_enough = {i for i, w in items.items() if len(w) >= 5}
    twice = decontamination.contained_items(table.union(table), bench.union(bench)).collect()
    assert len(twice) == 4 * len({x for x in want if x[1] in long_enough}) and {(r["doc_id"], r["item_id"]) for r in twice} == {x for x in want if x[1] in long_enough}
    assert {r["item_id"] for r in decontamination.left_out(bench).collect()} == {98, 99} | (set(items) - long_enough)
    assert decontamination.contained_items(table, bench.limit(0)).count() == decontamination.contained_items(table.limit(0), bench).count() == 0


@pytest.mark.parametrize("n", [100, 400])
def test_stock_phrases_make_no_candidates(spark, monkeypatch, n):
    """Items and documents that share a phrase, none of which holds an item, but for one planted whole and one with a gap."""
    r = random.Random(n)
    words = lambda k: [f"s{r.randrange(10**8)}" for _ in range(k)]
    phrase, items = words(20), {i: words(15) for i in range(n)}
    docs = {d: words(40) + phrase + words(20) for d in range(n)}
    docs[7] += items[3] + phrase
    docs[9] = docs[9] + items[5] + ["gap"] + phrase
    bench = spark.createDataFrame([(i, " ".join(w + phrase)) for i, w in items.items()], "item_id long, text string")
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    counts, plain = {}, decontamination.stash

    def counted(df, name):
        kept = plain(df, name)
        counts[name] = kept.count()
        return kept

    monkeypatch.setattr(decontamination, "stash", counted)
    got = decontamination.contained_items(table, bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == {(7, 3), (9, 5)}
    assert counts["candidates"] <= n and counts["hits"] <= 80 * n


def test_decontamination_odd_input(spark, odd, empty, monkeypatch):
    """Null ids on both sides, very long texts, and a document with more candidates than one list holds."""
    base = " ".join(f"word{i}" for i in range(80))
    bench = spark.createDataFrame([(None, "word1 word2 word3 word4 word5 word6"), (1, "ab ab ab ab ab ab"), (2, None), (3, ""), (4, base), (4, base), (5, "x" * 50_000)], "item_id long, text string")
    bench = bench.withColumn("width", F.lit("clash")).withColumn("times", F.lit("clash"))
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontamination.contained_items(odd, bench).collect()), key=repr)
    holders = [5, 5, 6, 7, 10, None]  # 7 has one word changed; 5 occurs twice
    changed = 7  # the changed word is in most of the short item
    want = [(d, None) for d in holders if d != changed] + [(d, 4) for d in holders for _ in range(2)] + [(8, 1)]
    assert got == sorted(want, key=repr)
    monkeypatch.setattr(decontamination, "LIST_ITEMS", 3)
    r = random.Random(2)
    items = [[f"q{r.randrange(10**8)}" for _ in range(12)] for _ in range(60)]
    many = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    long = spark.createDataFrame([(None, " ".join(w for item in items for w in item + ["and"] * 500))], "doc_id long, text string")
    assert sorted(r["item_id"] for r in decontamination.contained_items(long, many).collect()) == list(range(60))
    assert decontamination.contained_items(empty, bench).count() == 0


# substrings


def brute_runs(texts, least):
    """Runs of words covered by windows that occur earlier without overlap; documents rank by their order in ``texts``."""
    first, runs = {}, defaultdict(list)
    for doc, text in enumerate(texts):
        words = [w for w in regex.finditer(r"[^\x20\x09-\x0D]+", text)]
        keys = [tuple(w[0].encode().lower() for w in words[i : i + least]) for i in range(len(words) - least + 1)]
        for at, key in enumerate(keys):
            seen = first.setdefault(key, (doc, at))
            if seen[0] < doc or at - seen[1] >= least:
                if runs[doc] and runs[doc][-1][1] >= at:
                    runs[doc][-1][1] = at + least
                else:
                    runs[doc].append([at, at + least])
        runs[doc] = [(words[a].start(), words[b - 1].end(), b - a) for a, b in runs[doc]]
    return {d: r for d, r in runs.items() if r}


@pytest.mark.parametrize("partitions", [1, 5])
def test_repeats_equal_brute_force(spark, partitions):
    r = random.Random(7)
    word = lambda n: [r.choice(["é", "W", "x"]) + str(r.randrange(n)) for _ in range(r.randrange(1, 60))]
    shared = [word(50) for _ in range(8)]
    texts = []
    for _ in range(120):
        parts = [r.choice(shared)[r.randrange(4) :] if r.random() < 0.5 else word(50) for _ in range(r.randrange(1, 6))]
        texts.append("".join(w + r.choice([" ", "  ", "\n", "\t "]) for p in parts for w in p))
    texts += [texts[3], texts[4].upper().replace("É", "é"), "same " * 70, " ".join(map(str, range(30))) * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)
    got = defaultdict(list)
    for x in substring_dedup.repeated_runs(docs, 9).collect():
        got[x["doc_id"]].append((x["start"], x["end"], x["words"]))
    assert {d: sorted(x) for d, x in got.items()} == brute_runs(texts, 9)


def test_long_repeats_equal_brute_force(spark):
    """Near copies of long texts, with excerpts of them in earlier and later documents: stretches, their first occurrences, and what stands earlier still."""
    r = random.Random(17)
    new = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    bases = [new(500) for _ in range(3)]
    texts = []
    for _ in range(60):
        base = list(r.choice(bases))
        kind = r.random()
        if kind < 0.4:  # an excerpt
            at = r.randrange(400)
            words = new(r.randrange(30)) + base[at : at + r.randrange(8, 90)] + new(r.randrange(30))
        elif kind < 0.8:  # a near copy
            for _ in range(r.randrange(1, 8)):
                at = r.randrange(len(base))
                base[at : at + r.randrange(3)] = new(r.randrange(3))
            words = base
        else:  # pieces after one another, some of them twice
            cuts = [(r.choice(bases), r.randrange(300), r.randrange(150)) for _ in range(4)]
            words = [w for b, at, n in cuts for w in b[at : at + n]]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = defaultdict(list)
    for x in substring_dedup.repeated_runs(docs, 12).collect():
        got[x["doc_id"]].append((x["start"], x["end"], x["words"]))
        words = texts[x["doc_id"]][x["start"] :].split()[:12]
        assert texts[x["first_doc_id"]][x["first_start"] :].split()[:12] == words
        first = next(d for d, t in enumerate(texts) if f" {' '.join(words)} " in f" {t} ")
        assert x["first_doc_id"] == first
    assert {d: sorted(x) for d, x in got.items()} == brute_runs(texts, 12)


def test_passages_inside_lines_are_found(spark):
    r = random.Random(5)
    own = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage = own(60)
    docs = spark.createDataFrame([(i, f"{own(30)} {passage} {own(30)}") for i in range(50)], "doc_id long, text string")
    removed = substring_dedup.repeated_runs(docs)
    assert sorted((x["doc_id"], x["words"], x["first_doc_id"]) for x in removed.collect()) == [(i, 60, 0) for i in range(1, 50)]
    cut = substring_dedup.without_repeats(docs, removed).where("doc_id > 0").collect()
    assert len(cut) == 49 and all(len(x["text"].split()) == 60 and passage not in x["text"] for x in cut)


def test_repeats_are_cut_where_they_stand(spark):
    passage = "\n".join(" ".join(f"p{j}w{k}" for k in range(30)) for j in range(2))
    data = [(1, "intro\n" + passage + "\nend"), (2, passage.upper() + "\nown words"), (3, "intro\nsomething else"), (4, None), (2, passage.upper() + "\nown words"), (2, "another text of that id " + passage)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    removed = substring_dedup.repeated_runs(docs)
    assert sorted((x["doc_id"], x["words"], x["first_doc_id"], x["first_start"]) for x in removed.collect()) == [(2, 60, 1, 6), (2, 60, 1, 6)]
    texts = sorted((x["doc_id"], x["text"]) for x in substring_dedup.without_repeats(docs, removed).collect() if x["text"])
    assert texts == [(1, data[0][1]), (2, "another text of that id "), (2, "own words"), (2, "own words"), (3, data[2][1])]


def test_substring_odd_input(odd, empty):
    removed = substring_dedup.repeated_runs(odd)
    cut = substring_dedup.without_repeats(odd, removed)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    # the text without an id ranks first, and its other copies go; the periodic text keeps one window
    assert {(x["doc_id"], x["words"]) for x in removed.collect()} == {(5, 80), (6, 80), (7, 76), (8, 29_950), (10, 160)}
    assert substring_dedup.repeated_runs(empty).count() == 0


# shared and pipeline


def test_scratch_is_the_named_folder(spark):
    assert common.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_pipeline_stages_do_as_their_operators_say(spark, same_rows):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rejects = {
        "quality": f"SELECT doc_id FROM ({queries.ORACLE_SQL['op7_quality_rules']}) WHERE NOT kept",
        "near_duplicates": f"SELECT doc_id FROM ({queries.ORACLE_SQL['op3_near_dedup']}) WHERE NOT kept",
        "decontaminate": f"SELECT doc_id FROM ({queries.ORACLE_SQL['op9_decontamination']})",
    }
    for name, rejected in rejects.items():
        after = common.stash(stages[name](spark, docs, DATA), name)
        assert after.columns == docs.columns
        same_rows(after, f"SELECT * FROM documents WHERE doc_id NOT IN ({rejected})", documents=docs)
        docs = after
    mixed = common.stash(stages["mix_sources"](spark, docs, DATA), "mixed")
    want = f"""WITH m AS ({queries.ORACLE_SQL['op2_mixing']}), c AS (SELECT doc_id, (taken // greatest(size, 1) + CASE WHEN size > 0 AND 2 * (taken % greatest(size, 1)) >= size THEN 1 ELSE 0 END)::INT AS n FROM m)
               SELECT d.* FROM documents d JOIN (SELECT doc_id, unnest(range(n)) FROM c) USING (doc_id)"""
    same_rows(mixed, want, documents=docs)
    assert stages["shard"](spark, mixed, DATA).count() == mixed.count()


def test_pipeline_equals_its_sql(same_rows):
    import corpus_pipeline

    same_rows(corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)


def test_rejected_rows_go_and_all_others_stay(spark, odd):
    gone = odd.where("doc_id IN (0, 5) OR doc_id IS NULL AND text IS NULL").select("doc_id", F.xxhash64("text").alias("text_key"))
    left = common.without_rows(odd, gone.union(spark.createDataFrame([(77, 1), (1, 77)], "doc_id long, text_key long")))
    assert left.columns == odd.columns and left.count() == odd.count() - 4  # 0, 5 twice, and the row without id and text
    assert left.where("doc_id IS NULL").count() == 1


def test_stages_tell_rows_by_id_and_text(spark):
    import corpus_pipeline

    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    clean = lambda k: " ".join(f"{k}{i}" for i in range(80))
    data = [(None, "too short"), (None, clean("a")), (7, "too short"), (7, clean("b")), (None, clean("c") + " " + item), (8, clean("d") + " " + item), (8, clean("e")), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], DOC_SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    good = common.stash(stages["quality"](spark, docs, DATA), "good")
    assert rows(good.select("doc_id", "text")) == sorted([x for x in data if x[1] not in (None, "too short")], key=repr)
    left = stages["decontaminate"](spark, good, DATA)
    assert rows(left.select("doc_id", "text")) == sorted([data[1], data[3], data[6]], key=repr)


def test_pipeline_odd_input(spark, odd, empty):
    """Short, empty and repetitive texts go; of the copies and near copies the rows of the least id stay, and the one without an id."""
    import corpus_pipeline

    want = {"quality": [5, 5, 6, 7, 10, None], "near_duplicates": [5, 5, None], "decontaminate": [5, 5, None]}
    docs, none = odd, empty
    for name, stage in corpus_pipeline.STAGES:
        before, docs, none = docs, common.stash(stage(spark, docs, DATA), "stage"), common.stash(stage(spark, none, DATA), "stage")
        assert none.count() == 0
        if name in want:
            assert docs.columns == odd.columns and sorted((r["doc_id"] for r in docs.collect()), key=repr) == sorted(want[name], key=repr)
        elif name == "mix_sources":
            assert docs.columns == odd.columns and {r["doc_id"] for r in docs.collect()} <= {5, None}
        else:
            placed = docs.collect()
            assert len(placed) == before.count()
            for shard in {r["shard"] for r in placed}:
                slots = sorted(r["slot"] for r in placed if r["shard"] == shard)
                assert slots == list(range(len(slots)))
