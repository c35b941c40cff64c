"""Matches that must not be lost, rank in linear time, and the inverted index."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docprov.operators import fulltext, postings
from docprov.operators.fulltext import Phrase, _starts

WORDS = "die dying dies died lie lying lies tie tying ties ski skis sky skies idly gently ugly early only singly news cosmos policy policies happily happier argue arguing arguably generate generous communism arsenal inning outing exceed succeeding yes youth saying employment try tries trying agreed feed hoping hopping hopes national rationally conditional"


def test_the_filter_drops_no_match(spark):
    words = [w for w in WORDS.split() if fulltext.lexeme(w, "english")]
    rows = spark.createDataFrame([(i, f"the man is {w}.") for i, w in enumerate(words)], "id int, content string")
    for x in sorted({fulltext.stem(w) for w in words}):
        query = fulltext.websearch(x)
        if not query:
            continue
        want = {i for i, w in enumerate(words) if fulltext.matches({fulltext.lexeme(w, "english"): [(4, 0.4)]}, query)}
        may = {r.id for r in rows.where(fulltext.may_match(F.col("content"), query)).collect()}
        assert want <= may
    found = lambda q: {words[r.id] for r in fulltext.search(rows, q).collect()}
    assert found("die") == {"die", "dying", "dies", "died"} and found("lie") == {"lie", "lying", "lies"} and found("tie") == {"tie", "tying", "ties"}


def slow_rank(own, query):
    """Cover density with every stretch judged by itself."""
    words = {x for g in query for p in g if p.wanted for x in p.lexemes}
    entries = sorted({(place, x, weight) for x in words for place, weight in own.get(x, ())})
    at, here = sorted({e[0] for e in entries}), {}
    for place, x, weight in entries:
        here.setdefault(place, []).append((x, weight))

    def holds(i, j):
        part = {}
        for place in at[i : j + 1]:
            for x, weight in here[place]:
                part.setdefault(x, []).append((place, weight))
        return any(all(_starts(part, p) for p in g if p.wanted) for g in query if any(p.wanted for p in g))

    total, i, j = 0.0, 0, 0
    while i < len(at):
        j = max(j, i)
        while j < len(at) and not holds(i, j):
            j += 1
        if j == len(at):
            break
        while i < j and holds(i + 1, j):
            i += 1
        inside = [here[p][0][1] for p in at[i : j + 1]]
        total += len(inside) / sum(1 / w for w in inside) / (1 + (at[j] - at[i]) - (len(inside) - 1))
        i += 1
    return total / (total + 1)


def test_rank_equals_the_slow_one():
    rng = random.Random(4)
    for _ in range(300):
        own, place = {}, 0
        for _ in range(rng.randrange(1, 25)):
            place += rng.randrange(1, 4)
            for x in rng.sample("abcd", rng.choice([1, 1, 1, 2])):
                own.setdefault(x, []).append((place, rng.choice([1.0, 0.4])))
        phrase = lambda: Phrase(*zip(*((x, n) for n, x in enumerate(rng.sample("abcd", rng.choice([1, 1, 2, 3])))), strict=True), wanted=rng.random() < 0.85)  # noqa: E731, B023
        query = [[phrase() for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 3))]
        assert fulltext.rank(own, query) == pytest.approx(slow_rank(own, query), abs=1e-12)


def test_rank_takes_linear_time():
    own = {"a": [(i, 0.4) for i in range(1, 16000, 2)], "b": [(i, 0.4) for i in range(2, 16000, 2)]}
    query = fulltext.websearch("xyz OR a")
    start = time.perf_counter()
    fulltext.rank({"z1": own["a"], "z2": own["b"]}, [[Phrase(("z1",), (0,)), Phrase(("z2",), (0,))], [Phrase(("z1", "z2"), (0, 1))]])
    assert time.perf_counter() - start < 1 and query


@pytest.fixture
def corpus(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, "Red Title", "policy"]), " ".join(rng.choice("the red blue policies policy green running runs a of x".split()) for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    rows += [(150, None, None), (151, "", ""), (152, "Title only", None), (153, None, "red " * 20_000)]
    return spark.createDataFrame(rows, "id int, title string, content string")


SAMPLES = {
    "german": "aufeinander aufeinand aufeinanderbiss aufeinanderbiss aufeinanderfolgende aufeinanderfolg aufeinanderschlügen aufeinanderschlug aufenthaltes aufenthalt auferlegen auferleg auferstanden auferstand auferstehung aufersteh auferstünde auferstund auffallen auffall kater kat kategorie kategori kategorischen kategor katers kat katholischer kathol kätzchen katzch katzen katz häuser haus",
    "spanish": "checa chec checoslovaquia checoslovaqui chelo chel chequeo cheque cheques chequ chiapas chiap chicas chic chicharrones chicharron torá tor tórax torax torcer torc toreado tor toreándolo tor torearlo tor toreó tore toreros torer tormentas torment torneo torne tornillos tornill torres torr torrencial torrencial",
    "french": "continua continu continuait continu continuation continu continuel continuel continuellement continuel continuerait continu continueront continu continuité continu continuons continuon mains main maintenaient mainten maintenant mainten maintenue maintenu maintien maintien maires mair maîtr maîtr maître maîtr majesté majest majestueuse majestu majestueusement majestu majeur majeur majorité major",
}


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_stems_of_other_languages(language):
    own = SAMPLES[language].split()
    assert {w: fulltext.lexeme(w, language) for w in own[::2]} == dict(zip(own[::2], own[1::2], strict=True))
    assert fulltext.lexeme({"german": "und", "spanish": "los", "french": "le"}[language], language) is None


def test_rows_are_stemmed_by_their_language(spark, tmp_path):
    rows = spark.createDataFrame([(1, "german", "Die Kategorien der Häuser"), (2, "french", "une continuation majestueuse"), (3, "spanish", "dos tormentas"), (4, "english", "the categories")], "id int, language string, content string")
    own = postings.Postings(spark, f"file://{tmp_path}/index", "int")
    own.append(rows, language=F.col("language"))
    for query, language, want in (("Kategorie Haus", "german", 1), ("continuer", "french", 2), ("tormenta", "spanish", 3), ("category", "english", 4)):
        assert [r.id for r in own.search(query, query_language=language).collect()] == [want]
        assert [r.id for r in fulltext.search(rows, query, language=F.col("language"), query_language=language).collect()] == [want]


QUERIES = ["policy", "red blue", '"red policy"', 'red -blue', '-red', '"running red" OR green -policy', "title", "the", "", "nowhere red", '"x green" -"policy red" run']


def test_the_index_finds_what_reading_all_texts_finds(spark, corpus, tmp_path):
    own = postings.Postings(spark, f"file://{tmp_path}/index", "int")
    own.append(corpus, title="title")
    for q in QUERIES:
        want = {r.id: round(r.text_score, 9) for r in fulltext.search(corpus, q, title="title").collect()}
        assert {r.id: round(r.text_score, 9) for r in own.search(q).collect()} == want, q
        few = corpus.where("id % 3 = 0")
        assert {r.id for r in own.search(q, among=few).collect()} == {i for i in want if i % 3 == 0}


def test_appends_touch_no_old_file_and_removals_and_merges_hold(spark, corpus, tmp_path):
    own = postings.Postings(spark, f"file://{tmp_path}/index", "int", buckets=4)
    own.append(corpus.where("id < 100"), title="title")
    before = {b: list(f) for b, f in own.tables.state().folders["lists"].items()}
    own.append(corpus.where("id >= 90"), title="title")  # ten again
    after = own.tables.state().folders["lists"]
    assert all(after[b][: len(f)] == f for b, f in before.items())
    for change in (lambda: None, lambda: own.remove(spark.createDataFrame([(5,), (95,), (999,)], "key int")), own.merge, lambda: own.append(corpus.where("id = 5"), title="title")):
        change()
        gone = {i for i in (5, 95) if own.tables.read("gone").count() or len(own.tables.state().folders["lists"])}
        there = {r.id for r in own.search("-nowhere").collect()}
        for q in ("red", "policy -blue"):
            want = {r.id: round(r.text_score, 9) for r in fulltext.search(corpus, q, title="title").collect() if r.id in there}
            assert {r.id: round(r.text_score, 9) for r in own.search(q).collect()} == want and gone
    assert there == set(range(154)) - {95}


def test_rows_without_a_key_and_empty_tables(spark, tmp_path):
    own = postings.Postings(spark, f"file://{tmp_path}/index", "string")
    own.append(spark.createDataFrame([], "id string, content string"))
    assert own.search("red").count() == 0
    own.append(spark.createDataFrame([(None, "red"), ("a", "red"), ("b", None)], "id string, content string"))
    assert [r.id for r in own.search("red").collect()] == ["a"]


def test_the_registered_queries_read_no_text(spark, sf):
    from docprov.plans.catalogue import QUERIES as NAMED

    plan = NAMED["hybrid_rrf"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "lists" not in plan or "text#" not in plan
    assert not any("ReadSchema" in line and "text:string" in line for line in plan.splitlines())


def test_places_leave_the_workers_in_bounded_batches(spark, monkeypatch):
    """a batch of ten thousand long texts was held as one list of dictionaries."""
    rows = spark.createDataFrame([(i, "title", "red policies " * 50 if i % 3 else None) for i in range(20)] + [(20, None, "")], "id int, title string, content string").coalesce(1)
    want = {r.id: [tuple(x) for x in r.lexemes] for r in fulltext.vectors(rows, title="title").collect()}
    assert want == {r.id: fulltext.places(r.title, r.content, "english") for r in rows.collect()}
    monkeypatch.setattr(fulltext, "HELD", 30)
    made, kept = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, *a: made.append(f) or kept(self, f, *a))
    got = fulltext.vectors(rows, title="title")
    assert {r.id: [tuple(x) for x in r.lexemes] for r in got.collect()} == want
    own = rows.withColumn("language", F.lit("english")).toArrow().combine_chunks().to_batches()
    sizes = [[len(x) for x in b.column(1).to_pylist()] for b in made[0](iter(own))]
    assert sum(map(len, sizes)) == 21 and max(map(sum, sizes)) <= 30 + 101


def test_ranks_are_rounded_once(spark, tmp_path):
    """F2: a rank of 0.1796874998 was rounded to nine digits, to 0.1796875, and then up to 0.179688."""
    from docprov.plans import search_queries

    class Index:
        def search(self, query, key):
            return spark.createDataFrame([(1, 0.1796874998), (2, 0.1796875004), (3, 0.5)], f"{key} long, text_score double")

    kept, search_queries.documents_index = search_queries.documents_index, lambda *a: Index()
    try:
        assert [tuple(r) for r in search_queries.fulltext_topk(spark, "").collect()] == [(3, 0.5), (1, 0.179687), (2, 0.179688)]
    finally:
        search_queries.documents_index = kept


def test_blocks_hold_the_places_of_every_text(corpus):
    """blocks are made of arrays of numbers, not word by word."""
    import pyarrow as pa

    held, want = postings.Held("s"), {postings.EVERY: {}}
    for n, r in enumerate(corpus.collect()):
        language = ["english", "german", "simple"][n % 3]
        held.add(r.id, r.title, r.content, language)
        want[postings.EVERY][r.id] = []
        for x, place, weight in fulltext.places(r.title, r.content, language):
            want.setdefault(x, {}).setdefault(r.id, []).append((place, {"A": fulltext.WEIGHT_A, "B": fulltext.WEIGHT_B}[weight]))
    got = {}
    for b in held.written(pa.int32()):
        for x, _, keys, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
            assert x not in got
            got[x] = {k: postings.unpacked(p) for k, p in zip(keys, places, strict=True)}
    assert got == want


def test_merging_puts_whole_blocks_together(spark, corpus, tmp_path):
    """F8: lists were taken apart key by key and put together again, in up to 64 blocks a lexeme."""
    own = postings.Postings(spark, f"file://{tmp_path}/index", "int", buckets=4)
    there = set()
    for n in range(3):  # what is merged is merged again
        rows = corpus.where(f"id % 3 = {n} OR id % 5 = {n}")
        own.append(rows, title="title")
        own.remove(rows.where("id % 7 = 1").select(F.col("id").alias("key")))
        there |= {r.id for r in rows.collect()}
        there -= {i for i in there if i % 7 == 1 and (i % 3 == n or i % 5 == n)}
        own.merge()
        lists = own.tables.read("lists")
        assert lists.count() == lists.select("lexeme").distinct().count() and own.tables.read("gone").count() == 0
        assert {r.id for r in own.search("-nowhere").collect()} == there
        for q in ("red", '"running red" OR green -policy', "title"):
            want = {r.id: round(r.text_score, 9) for r in fulltext.search(corpus, q, title="title").collect() if r.id in there}
            assert {r.id: round(r.text_score, 9) for r in own.search(q).collect()} == want


def test_merged_blocks_are_bounded_and_lose_nothing(monkeypatch):
    """F8: of a lexeme's keys those go that a later commit took, and no others; segments of other bins stay apart."""
    import pyarrow as pa

    monkeypatch.setattr(postings, "BLOCK", 3)
    monkeypatch.setattr(postings, "BLOCK_PLACES", 6)
    rng, rows, want = random.Random(3), [], {}
    gone = {k: "000000000002" for k in (2, 5, 11)}
    for x in "abc":
        for box in (0, 1):
            for segment in ("000000000001.0.0", "000000000002.1.0"):
                keys = rng.sample(range(20), rng.randrange(1, 8))
                places = [rng.randbytes(2 * rng.randrange(1, 4)) for _ in keys]
                rows.append((box, x, segment, keys, places))
                want.setdefault((box, x), []).extend((k, p) for k, p in zip(keys, places, strict=True) if segment[:12] >= gone.get(k, ""))
    blocks = postings.packed(pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows], pa.list_(pa.int64())), pa.array([r[4] for r in rows], pa.list_(pa.binary()))], names=["lexeme", "segment", "keys", "places"]))
    names = ["bin", "lexeme", "segment", "keys", "ends", "places", "gone"]
    lists = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), *blocks.columns, pa.nulls(len(rows), pa.string())], names=names)
    dead = pa.RecordBatch.from_pylist([dict(zip(names, (0, None, "s", [2, 11], None, None, "000000000002"), strict=True)), dict(zip(names, (1, None, "s", [5], None, None, "000000000002"), strict=True))], schema=lists.schema)
    for batches in ([dead, lists], pa.Table.from_batches([dead, lists]).combine_chunks().to_batches()):
        got = {}
        for b in postings.merged(iter(batches), "000000000003"):
            for r in b.to_pylist():
                assert len(r["keys"]) <= 3
            for r in postings.opened([b.select(["lexeme", "segment", "keys", "ends", "places"])]):
                for x, segment, k, p in zip(*(c.to_pylist() for c in r.columns), strict=True):
                    got.setdefault((int(segment.split(".")[1]), x), []).append((k, p))
        assert got == {k: v for k, v in want.items() if v}


def test_pieces_of_several_words_and_of_none(spark):
    """F8: words are looked up by the pieces between white space."""
    import pyarrow as pa

    texts = ["a-b c_d don't -- ' ... x", "---", "a,b,c,d,e,f,g,h,i,j,k,l,m,n " * 3, "ΑΣ. ΑΣΑ É_é ﬀ ǅ 12.5\x1cz", "policies, policies. (policy) the the"]
    held, want = postings.Held("s"), {}
    for n, text in enumerate(texts):
        held.add(n, None, text, "english")
        for x, place, _ in fulltext.places(None, text, "english"):
            want.setdefault(x, {}).setdefault(n, []).append(place)
    got = {x: {k: [p for p, _ in postings.unpacked(v)] for k, v in zip(keys, places, strict=True)} for b in held.written(pa.int32()) for x, _, keys, places in zip(*(c.to_pylist() for c in b.columns), strict=True) if x}
    assert got == want


def test_words_beyond_the_last_place_rank_as_in_the_sql(spark, tmp_path):
    """One word there or both, and both next to each other before it."""
    from docprov.plans.catalogue import QUERIES, SQL
    from tests.compare import connection

    fill = lambda n: "x " * n
    texts = [fill(16400) + "thes x bleing", "thes " + fill(16400) + "bleing x bleing", "thes bleing " + fill(16400) + "thes thes", "x thes x x bleing", "bleing", fill(16380) + "thes ble bleingly", "thes " + fill(16390) + "thes x ble", None]
    spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/made")
    (part,) = (tmp_path / "made").glob("*.parquet")
    part.rename(tmp_path / "documents.parquet")
    got = [tuple(r) for r in QUERIES["fulltext_topk"](spark, str(tmp_path)).collect()]
    want = connection(str(tmp_path)).execute(SQL["fulltext_topk"]).fetchall()
    assert [(i, str(score)) for i, score in got] == [(i, str(score)) for i, score in want]
    assert [i for i, score in got if score != score] == [0, 6]
    plain = {r.doc_id: r.text_score for r in postings_of(spark, tmp_path).search("thes bleing", "doc_id").collect()}
    assert 0 < plain[0] < 1 and set(plain) == {i for i, _ in got}


def postings_of(spark, tmp_path):
    own = postings.Postings(spark, f"{tmp_path}/own")
    own.append(spark.read.parquet(f"{tmp_path}/documents.parquet"), "text", key="doc_id")
    return own
