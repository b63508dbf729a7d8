"""Enrichment in rounds: resolvers that need facts of an entity and give others, asked until nothing is new.

What becomes of an entity depends on its facts alone, so entities of equal seeds
are resolved as one: the rounds run over distinct sets of facts, each one row with its
facts as a map, and the entities meet their set again at the end. A round takes only the
sets that the round before changed (nothing can be new for the others), and takes the
resolvers in order, each seeing what those before it gave. A resolver is asked each
question once, whatever the number of entities and rounds that have it; its answers are
kept in a memo. Every offer is kept, accepted or not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import names as N
from sievelake.operators.candidates import mapped
from sievelake.operators.facts import ALBUM_FIT, TRUST
from sievelake.runtime import broadcast_if_small, cut, is_blank

_FACTS = "map<string,struct<value:string,source:string>>"
_LOG = "array<struct<round:int,resolver:string,field:string,value:string,source:string,accepted:boolean,why:string>>"
_STATE = f"struct<facts:{_FACTS},log:{_LOG},changed:boolean>"
OFFER = "array<struct<field:string,value:string,source:string>>"
Get = Callable[[str], Column]
#: Ends carry their logs, so fewer of them than of plain keys are broadcast.
ENDS = 20_000


@dataclass(frozen=True)
class Resolver:
    """What a resolver needs and gives, and how it answers.

    It is asked where all it needs is known and some of what it gives isn't. ask takes distinct
    questions (columns named as `needs`) and returns the questions with a column `record`
    and, where their order matters, `rank`; a question may have none or a few. offers takes
    a getter of the entity's facts and its records in order, and returns an array of
    (field, value, source); blank values are no offers.
    """

    name: str
    needs: tuple[str, ...]
    gives: tuple[str, ...]
    ask: Callable[[DataFrame], DataFrame]
    offers: Callable[[Get, Column], Column]


@dataclass
class Resolved:
    """rows: (entity, facts, log, rounds, settled); memo: (resolver, question, records), the questions that were asked and how many records each had. settled is false where the rounds ended while a resolver could still be asked."""

    rows: DataFrame
    memo: DataFrame

    def facts(self) -> DataFrame:
        """(entity, field, value, source): what is held in the end."""
        return self.rows.select("entity", F.explode("facts").alias("field", "x")).select("entity", "field", "x.*")

    def attempts(self) -> DataFrame:
        """(entity, seq, round, resolver, field, value, source, accepted, why): every offer in order."""
        return self.rows.select("entity", F.posexplode("log").alias("seq", "x")).select("entity", "seq", "x.*")

    def unsettled(self) -> DataFrame:
        """The entities that further rounds could still change."""
        return self.rows.where("NOT settled").select("entity")


def _get(field: str) -> Column:
    return F.try_element_at("facts", F.lit(field))["value"]


def _question(values: list[Column]) -> Column:
    return F.to_json(F.array(*[v.cast("string") for v in values]))


def _ready(r: Resolver) -> Column:
    known, missing = F.lit(True), F.lit(False)
    for f in r.needs:
        known &= _get(f).isNotNull()
    for f in r.gives:
        missing |= _get(f).isNull()
    return known & missing & ~F.array_contains("fired", F.concat(F.lit(r.name + " "), _question([_get(f) for f in r.needs])))


def _wanted(active: DataFrame, resolvers: list[Resolver]) -> tuple[dict[str, bool], dict[str, bool], bool]:
    """Of each resolver whether any set has a question for it, and whether any changed set has; whether any set has changed. One pass."""
    seen = active.agg(F.max("changed"), *[F.max(_ready(r)) for r in resolvers], *[F.max(_ready(r) & F.col("changed")) for r in resolvers]).first()
    names, flags = [r.name for r in resolvers], list(map(bool, seen))
    return dict(zip(names, flags[1 : len(names) + 1], strict=True)), dict(zip(names, flags[len(names) + 1 :], strict=True)), flags[0]


def _taken(offers: Column, n: int, name: str, trust: dict[str, int]) -> Column:
    """The state after an array of offers: one is accepted if the field has no value, or if its source is believed more than the value's and says another."""

    def step(s: Column, x: Column) -> Column:
        mine = F.try_element_at(s["facts"], x["field"])
        weak = mapped(x["source"], trust, 0) <= mapped(mine["source"], trust, 0)
        why = F.when(mine.isNull(), "accepted").when(mine["value"] == x["value"], "agrees").when(weak, F.concat(F.lit("outranked by "), mine["source"])).otherwise("accepted")
        ok = why == "accepted"
        with_ = F.map_concat(F.map_filter(s["facts"], lambda k, _: k != x["field"]), F.create_map(x["field"], F.struct(x["value"].alias("value"), x["source"].alias("source"))))
        entry = F.struct(F.lit(n).alias("round"), F.lit(name).alias("resolver"), x["field"].alias("field"), x["value"].alias("value"), x["source"].alias("source"), ok.alias("accepted"), why.alias("why"))
        return F.struct(F.when(ok, with_).otherwise(s["facts"]).alias("facts"), F.concat(s["log"], F.array(entry)).alias("log"), (s["changed"] | ok).alias("changed")).cast(_STATE)

    start = F.struct("facts", "log", "changed").cast(_STATE)
    return F.aggregate(F.filter(offers.cast(OFFER), lambda x: ~is_blank(x["value"])), start, step)


def resolve(seeds: DataFrame, resolvers: list[Resolver], trust: dict[str, int] = TRUST, rounds: int = 5) -> Resolved:
    """The facts of seeds (entity, field, value) grown by resolvers for at most `rounds` rounds.

    Blank values are no facts; of values repeated for a field the smallest is the seed's. An
    entity leaves the rounds when one changes nothing for it. Entities without a usable fact, and an empty table, give no rows.
    """
    facts = seeds.where(~is_blank(F.col("value")) & F.col("field").isNotNull()).groupBy("entity", "field").agg(F.min("value").alias("value"))
    held = facts.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("field", "value"))).alias("seed"))
    held = cut(held.withColumn("mark", F.xxhash64("seed")))
    sets = held.select("mark", "seed").distinct()
    known = F.map_from_entries(F.transform("seed", lambda x: F.struct(x["field"], F.struct(x["value"].alias("value"), F.lit("seed").alias("source"))))).cast(_FACTS)
    active = cut(sets.select("mark", "seed", known.alias("facts"), F.array().cast("array<string>").alias("fired"), F.array().cast(_LOG).alias("log"), F.lit(True).alias("changed")))
    _, wanted, _ = _wanted(active, resolvers)
    memo: dict[str, DataFrame] = {}
    kept = None
    for n in range(1, rounds + 1):
        active = active.where("changed").withColumn("changed", F.lit(False))
        after, changed = {}, False
        for r in resolvers:
            if not wanted[r.name]:
                continue
            ready = F.coalesce(_ready(r), F.lit(False))
            asked = active.where(ready)
            new = asked.select(*[_get(f).alias(f) for f in r.needs]).distinct().withColumn("question", _question([F.col(f) for f in r.needs]))
            if r.name in memo:
                new = new.join(broadcast_if_small(memo[r.name].select("question")), "question", "left_anti")
            new = cut(new)
            got = r.ask(new.select(*r.needs))
            rank = F.col("rank") if "rank" in got.columns else F.lit(0)
            got = got.groupBy(_question([F.col(f) for f in r.needs]).alias("question")).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "record"))), lambda x: x["record"]).alias("records"))
            answered = cut(new.select("question").join(got, "question", "left"))
            memo[r.name] = answered if r.name not in memo else memo[r.name].unionByName(answered)
            # Sets that ask nothing keep their place beside the others, under keys that spread and are no question: a union would add to the partitions with each answer.
            told = active.withColumn("ready", ready).withColumn("question", F.when(F.col("ready"), _question([_get(f) for f in r.needs])).otherwise(F.col("mark").cast("string")))
            told = told.join(broadcast_if_small(memo[r.name]), "question", "left")
            s = F.when(F.col("ready"), _taken(r.offers(_get, F.coalesce("records", F.array())), n, r.name, trust)).otherwise(F.struct("facts", "log", "changed").cast(_STATE))
            fired = F.when(F.col("ready"), F.concat("fired", F.array(F.concat(F.lit(r.name + " "), "question")))).otherwise(F.col("fired"))
            active = cut(told.withColumn("s", s).select("mark", "seed", "s.facts", fired.alias("fired"), "s.log", "s.changed"))
            wanted, after, changed = _wanted(active, resolvers)
        out = active.where(~F.col("changed") | F.lit(n == rounds)).withColumn("rounds", F.lit(n))
        kept = out if kept is None else kept.unionByName(out)
        if not changed:
            break
        wanted = after
    open_ = F.lit(False)
    for r in resolvers:
        open_ |= F.coalesce(_ready(r), F.lit(False))
    ends = kept.select("mark", "seed", "facts", "log", "rounds", (~open_).alias("settled"))
    rows = held.join(broadcast_if_small(ends, ENDS), ["mark", "seed"]).select("entity", "facts", "log", "rounds", "settled")
    asked = None
    for name, m in memo.items():
        one = m.select(F.lit(name).alias("resolver"), "question", F.coalesce(F.size("records"), F.lit(0)).alias("records"))
        asked = one if asked is None else asked.unionByName(one)
    if asked is None:
        asked = rows.sparkSession.createDataFrame([], "resolver string, question string, records int")
    return Resolved(rows, asked)


def looked_up(table: DataFrame, keys: dict[str, str], rank: Column | None = None, most: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """How a table answers: the rows whose columns equal the needs (keys: need to column), at most `most` by rank. Questions are distinct, so each row is read for one of them."""

    def ask(questions: DataFrame) -> DataFrame:
        t = table.select(*[F.col(c).cast("string").alias(need) for need, c in keys.items()], F.struct(*table.columns).alias("record"), (rank if rank is not None else F.lit(0)).alias("rank"))
        got = t.join(broadcast_if_small(questions), list(keys))
        if most is not None:
            best = F.slice(F.array_sort(F.collect_list(F.struct("rank", "record"))), 1, most)
            got = got.groupBy(*keys).agg(best.alias("x")).select(*keys, F.inline("x"))
        return got

    return ask


def offer(field: str, value: Column, source: str) -> Column:
    return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(source).alias("source"))


def same_version(a: Column, b: Column) -> Column:
    """Whether two titles have the same version words; true where the first is blank."""
    x, y = N.version_words(a), N.version_words(b)
    return is_blank(a) | (F.size(F.array_except(x, y)) + F.size(F.array_except(y, x)) == 0)


def year_of(c: Column) -> Column:
    """The first four digits in a row, if from 1900 to 2030."""
    y = F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"([0-9]{4})", 1).try_cast("int")
    return F.when(y.between(1900, 2030), y.cast("string"))


def _none() -> Column:
    return F.array().cast(OFFER)


def _first(records: Column, fits: Callable[[Column], Column], made: Callable[[Column], list[Column]]) -> Column:
    """The offers of the first record that fits."""
    hit = F.try_element_at(F.filter(records, fits), F.lit(1))
    return F.transform(F.filter(F.array(hit), lambda x: x.isNotNull()), lambda x: F.array(*made(x)).cast(OFFER))


def _flat(nested: Column) -> Column:
    return F.coalesce(F.flatten(nested), _none())


#: Least fit of an artist, a title or an album; codes of a recording that are tried; what such a code looks like.
NAME_FIT, CODES, CODE = 0.6, 4, r"^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$"


def _cover(get: Get, album: Column, url: Column, source: str) -> Column:
    """A cover is offered only if no album is known or the cover's album fits it."""
    ours = get("album")
    return offer("cover_url", F.when(is_blank(ours) | (N.fit(ours, album) >= ALBUM_FIT), url), source)


def _track(get: Get, x: Column) -> list[Column]:
    d = "deezer"
    several = F.when(F.size(x["contributors"]) > 1, F.array_join(x["contributors"], "; "))
    tempo = F.when(x["bpm"] > 0, F.round(x["bpm"].cast("double"), 1))
    return [offer("deezer_id", x["id"], d), offer("title", x["title"], d), offer("artist", x["artist"], d), offer("all_artists", several, d), offer("isrc", F.when(x["isrc"].rlike(CODE), x["isrc"]), d), offer("track_number", x["track_number"], d), offer("disc_number", x["disc_number"], d), offer("explicit", F.coalesce(x["explicit"], F.lit(False)), d), offer("bpm_deezer", tempo, d), offer("year", year_of(x["release_date"]), d), offer("deezer_album_id", x["album_id"], d), offer("album", x["album"], d), _cover(get, x["album"], x["cover"], d)]


def catalogue_resolvers(tracks: DataFrame, albums: DataFrame, recordings: DataFrame, groups: DataFrame, covers: DataFrame, artists: DataFrame) -> list[Resolver]:
    """The resolvers over two catalogues kept as tables, in the order in which they are asked.

    tracks (id, artist, title, isrc, track_number, disc_number, explicit, bpm, release_date, album_id, album, cover,
    contributors; q_artist, q_title, rank: the search it answers), albums (id, title, label, release_date, total_tracks, cover,
    genres), recordings (id, title, artists, artist_id, isrcs, length_ms, genres, tags; album, year, group_id, release_id,
    release_type of its earliest release), groups (id, title, artists, release_date, kind; q_artist, q_album, rank), covers (group_id, url, front),
    artists (id, name, aliases). contributors, artists (of recordings and groups), isrcs, genres, tags and aliases are arrays.
    """
    d, m = "deezer", "musicbrainz"
    name = lambda x: F.array_join(x, "; ")
    coded = recordings.select("id", "title", "artists", F.explode("isrcs").alias("code"))

    def searched(get: Get, records: Column) -> Column:
        fits = lambda x: (N.fit(get("artist"), x["artist"]) >= NAME_FIT) & (N.fit(get("title"), x["title"]) >= NAME_FIT) & same_version(get("title"), x["title"])
        return _flat(_first(records, fits, lambda x: [offer("deezer_id", x["id"], d)]))

    def track(get: Get, records: Column) -> Column:
        return _flat(_first(F.slice(records, 1, 1), lambda x: same_version(get("title"), x["title"]), lambda x: _track(get, x)))

    def album(get: Get, records: Column) -> Column:
        genres = lambda x: F.when(F.size(x["genres"]) > 0, name(x["genres"]))
        # The cover is held against the album that is known once the record's own title was offered.
        known = lambda x: (lambda f: F.coalesce(get("album"), x["title"]) if f == "album" else get(f))
        return _flat(_first(records, lambda x: F.lit(True), lambda x: [offer("album", x["title"], d), offer("label", x["label"], d), offer("year", year_of(x["release_date"]), d), offer("total_tracks", x["total_tracks"], d), _cover(known(x), x["title"], x["cover"], d), offer("genres", genres(x), d)]))

    def by_codes(questions: DataFrame) -> DataFrame:
        each = questions.select("isrcs", F.posexplode(F.slice(F.split("isrcs", "; "), 1, CODES)).alias("rank", "isrc"))
        return one.where("isrc IS NOT NULL").select("isrc", F.struct(*tracks.columns).alias("record")).join(broadcast_if_small(each), "isrc").select("isrcs", "rank", "record")

    def coded_track(get: Get, records: Column) -> Column:
        return _flat(_first(records, lambda x: same_version(get("title"), x["title"]), lambda x: [*_track(get, x), offer("isrc", x["isrc"], m)]))

    def recording(get: Get, records: Column) -> Column:
        codes = lambda x: F.filter(F.coalesce(x["isrcs"], F.array().cast("array<string>")), lambda i: i.rlike(CODE))
        genres = lambda x: F.when(F.size(x["genres"]) > 0, name(x["genres"])).when(F.size(x["tags"]) > 0, name(F.slice(x["tags"], 1, 5)))
        return _flat(_first(records, lambda x: F.lit(True), lambda x: [offer("isrcs", name(codes(x)), m), offer("isrc", F.when(F.size(codes(x)) == 1, F.try_element_at(codes(x), F.lit(1))), m), offer("title", x["title"], m), offer("artist", name(x["artists"]), m), offer("artist_id", F.when(F.size(x["artists"]) > 0, x["artist_id"]), m), offer("length_ms", F.when(x["length_ms"] > 0, x["length_ms"]), m), offer("genres", genres(x), m), offer("album", x["album"], m), offer("year", year_of(x["year"]), m), offer("release_group_id", x["group_id"], m), offer("release_id", x["release_id"], m), offer("release_type", x["release_type"], m)]))

    def chosen(get: Get, records: Column) -> Column:
        """Of several recordings of one code: the same version first, then the best fit of title and artist to thousandths, then the smallest id."""
        score = lambda x: F.struct((~same_version(get("title"), x["title"])).alias("other"), F.when(is_blank(get("title")), 0.0).otherwise(-F.round(N.fit(get("title"), x["title"]), 3)).alias("t"), F.when(is_blank(get("artist")), 0.0).otherwise(-F.round(N.fit(get("artist"), F.array_join(x["artists"], ", ")), 3)).alias("a"), x["id"].cast("string").alias("id"))
        best = F.try_element_at(F.array_sort(F.transform(records, score)), F.lit(1))
        return F.array(offer("recording_id", best["id"], m)).cast(OFFER)

    def group(get: Get, records: Column) -> Column:
        fits = lambda x: (N.fit(get("artist"), name(x["artists"])) >= NAME_FIT) & (N.fit(get("album"), x["title"]) >= NAME_FIT)
        return _flat(_first(records, fits, lambda x: [offer("release_group_id", x["id"], m), offer("year", year_of(x["release_date"]), m), offer("release_type", x["kind"], m)]))

    def front(get: Get, records: Column) -> Column:
        return _flat(_first(records, lambda x: x["front"], lambda x: [offer("cover_url", x["url"], "coverartarchive")]))

    def artist(get: Get, records: Column) -> Column:
        return _flat(_first(records, lambda x: F.lit(True), lambda x: [offer("artist_canonical", x["name"], m), offer("artist_aliases", F.when(F.size(x["aliases"]) > 0, name(x["aliases"])), m)]))

    rank = F.col("rank")
    one = tracks.groupBy("id").agg(F.min(F.struct(*tracks.columns)).alias("x")).select("x.*")
    return [
        Resolver("deezer-search", ("artist", "title"), ("deezer_id",), looked_up(tracks, {"artist": "q_artist", "title": "q_title"}, rank, 5), searched),
        Resolver("deezer-track", ("deezer_id",), ("bpm_deezer", "isrc", "deezer_album_id", "track_number", "all_artists", "explicit"), looked_up(one, {"deezer_id": "id"}), track),
        Resolver("deezer-album", ("deezer_album_id",), ("label", "genres", "total_tracks", "cover_url"), looked_up(albums, {"deezer_album_id": "id"}), album),
        Resolver("deezer-by-isrc", ("isrcs",), ("deezer_id", "bpm_deezer", "track_number"), by_codes, coded_track),
        Resolver("mb-recording", ("recording_id",), ("isrc", "genres", "year"), looked_up(recordings, {"recording_id": "id"}), recording),
        Resolver("mb-by-isrc", ("isrc",), ("recording_id",), looked_up(coded, {"isrc": "code"}), chosen),
        Resolver("mb-release-group", ("artist", "album"), ("year",), looked_up(groups, {"artist": "q_artist", "album": "q_album"}, rank, 5), group),
        Resolver("cover-art", ("release_group_id",), ("cover_url",), looked_up(covers, {"release_group_id": "group_id"}), front),
        Resolver("mb-artist", ("artist_id",), ("artist_canonical", "artist_aliases"), looked_up(artists, {"artist_id": "id"}), artist),
    ]
