"""The readings printed beside places in a text, and what they prove about a form's language.

A text is an array of pieces, what white space leaves. From each place a walk
goes left, then right, over at most three pieces and ends at the first that is
no reading; one piece of punctuation alone may lie between. Only the few pieces
around a place leave the text, so no text is sorted or held by pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.syllables import japanese, pinyin, spelled, unmarked
from ..sources.shared import spread, stored

#: Marks of romanizations, scripts that are readings themselves, and clause ends that introduce what follows.
HEPBURN, IAST, BREVE = "[ōū]", "[ṣṇṭḍśṛṃṅṁḥ]", "[ŏŭŎŬ]"
TONE, OTHER_TONE = "[āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜ]", "[áǎàéěèíǐìóǒòúǔùǖǘǚǜ]"
REVISED = "eo|eu"
KANA, HANGUL = "[぀-ヿ]", "[가-힯ᄀ-ᇿ㄰-㆏]"
INTRODUCES = "[:;.][\"”’)\\]]*$"
TONED = 20
SUBJECTS = {"ja": "japan", "zh": "china", "ko": "korea"}
#: What no run of pinyin's syllables has: a consonant that no vowel follows, but for n, ng, er, zh, ch and sh.
NO_PINYIN = "[bdfhjklmpqtwxy][^aeiouü]|[zcs][^aeiouüh]|v|[bcdfhjklmpqstvwxyz]$"
#: Pieces of ASCII letters, a sign behind them or not, that can prove nothing: too short, or neither eo nor eu nor pinyin.
MUTE = f"(?i)^(?=[a-z]+[.,;:!?]?$)(?:[a-z]{{1,3}}[.,;:!?]?$|(?!.*e[ou])(?=.*(?:{NO_PINYIN}|[bcdfhjklmpqstvwxyz][.,;:!?]$)))"
#: Pieces that a walk may touch: one of punctuation and three readings.
REACH = 4


def facts(forms: DataFrame, listed: DataFrame) -> DataFrame:
    """(form, f): what each piece shows of itself.

    listed (word): words of the document's own language; a piece is one without
    what is no word character around it, in lower case. Each step is a
    projection of its own, so that nothing is worked out twice; words are folded
    over only where they can be pinyin, and told to be Japanese too where they are.
    """
    own = listed.select("word").distinct().withColumn("_listed", F.lit(True))
    rows = forms.select("form", F.regexp_replace("form", r"(?U)^\W+|\W+$", "").alias("core")).withColumn("word", F.lower("core")).join(own, "word", "left")
    rows = rows.withColumn("bare", F.regexp_replace(unmarked(F.col("word"), umlauts=True), "['’]", "")).withColumn("plain", F.replace("bare", F.lit("-"), F.lit("")))
    rows = rows.withColumn("hepburn", F.col("word").rlike(HEPBURN) & ~F.col("word").rlike(IAST) & ~F.col("word").rlike(OTHER_TONE))
    rows = rows.withColumn("hepburn", F.when(F.col("hepburn"), spelled(F.replace(F.translate("word", "āīūēō", "aiueo"), F.lit("-"), F.lit("")), japanese())).otherwise(F.lit(False)))
    rows = rows.withColumn("shape", F.when(F.col("plain").rlike("^[a-zü]+$") & ~F.col("plain").rlike(NO_PINYIN), spelled(F.col("plain"), pinyin(umlauts=True))).otherwise(F.lit(False)))
    rows = rows.withColumn("japanese", F.when(F.col("shape"), spelled(F.col("plain"), japanese())).otherwise(F.lit(False)))
    return rows.select("form", F.struct(
        F.col("form").rlike(KANA).alias("kana"), F.col("form").rlike(HANGUL).alias("hangul"), "core", F.col("plain").rlike(r"^\p{L}+$").alias("sound"), "hepburn",
        "shape", F.coalesce("_listed", F.lit(False)).alias("listed"), F.col("word").rlike(TONE).alias("tone"), F.col("word").rlike(OTHER_TONE).alias("other_tone"),
        F.col("core").rlike(BREVE).alias("breve"), F.col("word").rlike(REVISED).alias("revised"), (F.length("word") > 3).alias("long"), (F.length("bare") > 3).alias("bare_long"),
        "japanese", F.col("form").rlike(r"(?U)^[\W_]+$").alias("punctuation"), F.col("form").rlike(INTRODUCES).alias("introduces"),
    ).alias("f"))


def reading(f: Column, subject: Column, toned: Column) -> Column:
    """The language that a piece of these facts proves, or null: ja, zh or ko.

    Kana and hangul prove theirs; a Hepburn word Japanese, unless it also fits
    pinyin in a book that writes tones; breves or Revised Romanization Korean in
    a book on Korea, where nothing proves Chinese; pinyin Chinese with a tone, or
    where it is long, not Japanese in shape and no word of the book's language.
    """
    korea = F.coalesce(subject == "korea", F.lit(False))
    korean = korea & ((f["breve"] & ~f["tone"]) | (f["revised"] & ~f["listed"] & f["long"]))
    chinese = f["shape"] & ~f["listed"] & ~f["breve"] & (f["other_tone"] | (f["bare_long"] & ~f["japanese"]))
    return (
        F.when(f["kana"], "ja").when(f["hangul"], "ko").when(~f["sound"], None).when(f["hepburn"], F.when(~(f["shape"] & toned), "ja"))
        .when(korean, "ko").when(~korea & chinese, "zh")
    )


def around(docs: DataFrame, place: Callable[[Column], Column], pieces: str = "pieces") -> DataFrame:
    """(doc_id, book, at, piece, before, after): each place with up to REACH pieces on either side, the nearest first.

    docs: doc_id, book and pieces (an array without nulls); place: whether a
    piece is one. A null or empty text has none. Native functions alone, so that
    a text's array is no part of any row but its own.
    """
    rows = docs.select("doc_id", "book", F.col(pieces).alias("_pieces"), F.posexplode(pieces).alias("_at", "piece")).where(F.coalesce(place(F.col("piece")), F.lit(False)))
    before = F.reverse(F.slice("_pieces", F.greatest(F.col("_at") - REACH, F.lit(0)) + 1, F.least("_at", F.lit(REACH))))
    after = F.slice("_pieces", F.col("_at") + 2, F.lit(REACH))
    return rows.select("doc_id", "book", F.col("_at").cast("long").alias("at"), "piece", before.alias("before"), after.alias("after"))


def _entry(f: Column, form: Column, r: Column) -> Column:
    """A reading: what it proves and how it is written."""
    return F.when(r.isNotNull(), F.struct(r.alias("r"), f["kana"].alias("kana"), f["hangul"].alias("hangul"), F.coalesce(F.nullif(f["core"], F.lit("")), form).alias("core")))


def _sides(places: DataFrame) -> DataFrame:
    """places with left, the pieces that a walk to the left would read (empty where what stands there introduces), and right, the readings right of the place.

    One piece of punctuation may lie between. Left of a place a piece that ends
    a clause introduces what follows and isn't read, and neither is what lies
    behind punctuation that does; right of it only kana and hangul count, as a
    romanization is the next entry's. Those are told without a look-up.
    """
    punctuation = lambda x: F.coalesce(x.rlike(r"(?U)^[\W_]+$"), F.lit(False))
    introduces = lambda x: F.coalesce(x.rlike(INTRODUCES), F.lit(False))
    rest = lambda side, between: F.when(between, F.slice(side, 2, 3)).otherwise(F.slice(side, 1, 3))
    rows = places.withColumn("_near", F.get("before", F.lit(0))).withColumn("_between", punctuation(F.col("_near"))).withColumn("left", rest("before", F.col("_between")))
    introduced = (F.col("_between") & introduces(F.col("_near"))) | introduces(F.get("left", F.lit(0)))
    rows = rows.withColumn("left", F.when(introduced, F.slice("left", 1, 0)).otherwise(F.col("left"))).withColumn("right", rest("after", punctuation(F.get("after", F.lit(0)))))
    own = lambda x: x.rlike(KANA) | x.rlike(HANGUL)
    stop = F.array_position(F.transform("right", lambda x: ~own(x)), True)
    took = F.when(stop == 0, F.col("right")).otherwise(F.slice("right", F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int")))

    def entry(x: Column) -> Column:
        kana = x.rlike(KANA)
        return F.struct(F.when(kana, "ja").otherwise("ko").alias("r"), kana.alias("kana"), x.rlike(HANGUL).alias("hangul"), F.coalesce(F.nullif(F.regexp_replace(x, r"(?U)^\W+|\W+$", ""), F.lit("")), x).alias("core"))

    return rows.withColumn("right", F.transform(took, entry)).drop("_near", "_between", "before", "after")


def beside(places: DataFrame, listed: DataFrame, toned: DataFrame) -> DataFrame:
    """(doc_id, book, at, piece, subject, readings): the readings in order of the text if they stand left of the place, else those right of it.

    listed (word): words of the document's own language; toned (book, toned):
    whether a book writes pinyin with tones. The subject is the commonest
    language among the three pieces on either side of the book's places, ties
    by name. Most pieces around places can prove nothing by a look at their
    letters; the others are classed once for each form, and few of them are
    readings, so a place looks up its nearest piece alone; only where that is a
    reading are the two behind it looked up.
    """
    side = lambda c: places.select("book", F.posexplode(c).alias("k", "form")).where(~F.col("form").rlike(MUTE))
    near = side("before").unionByName(side("after").where("k < 3"))
    near = stored(near.groupBy("book", "form").agg(F.count_if(F.col("k") < 3).alias("n")), "near-pieces")
    f = F.col("f")
    speaks = f["kana"] | f["hangul"] | f["sound"] & (f["hepburn"] | f["breve"] & ~f["tone"] | f["revised"] & ~f["listed"] & f["long"] | f["shape"] & ~f["listed"] & ~f["breve"] & (f["other_tone"] | f["bare_long"] & ~f["japanese"]))
    forms = stored(facts(spread(near.select("form").distinct(), "form"), listed).where(speaks), "facts")
    # A book's subject: what three pieces on either side prove without one.
    votes = near.where("n > 0").join(forms, "form").select("book", "n", reading(f, F.lit(None).cast("string"), F.lit(False)).alias("r")).where("r is not null").groupBy("book", "r").agg(F.sum("n").alias("count"))
    best = votes.groupBy("book").agg(F.max_by("r", F.struct("count", F.translate("r", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"))).alias("r"))
    subjects = best.select(F.col("book"), F.create_map(*(F.lit(x) for p in SUBJECTS.items() for x in p))[F.col("r")].alias("subject"))
    about = stored(toned.join(subjects, toned["book"].eqNullSafe(subjects["book"]), "left").select(toned["book"].alias("_book"), "toned", "subject"), "books")  # a row for each book

    def looked_up(rows: DataFrame, k: int) -> DataFrame:
        """rows with x<k>: what the k-th piece to the left reads, or null."""
        rows = rows.withColumn("_form", F.get("left", F.lit(k))).join(forms.withColumnRenamed("form", "_known"), F.col("_form") == F.col("_known"), "left")
        r = F.when(F.col("_known").isNotNull(), reading(f, F.col("subject"), F.coalesce("toned", F.lit(False))))
        return rows.withColumn("_r", r).withColumn(f"x{k}", _entry(f, F.col("_form"), F.col("_r"))).drop("_form", "_known", "_r", "f")

    rows = _sides(places).join(about, F.col("book").eqNullSafe(F.col("_book")), "left").drop("_book")
    may = F.coalesce(~F.get("left", F.lit(0)).rlike(MUTE), F.lit(False))
    asked = stored(looked_up(rows.where(may), 0), "nearest-pieces")
    columns = ["doc_id", "book", "at", "piece", "subject"]
    none = rows.where(~may).unionByName(asked.where("x0 is null").drop("x0")).select(*columns, F.col("right").alias("readings"))
    read = looked_up(looked_up(asked.where("x0 is not null"), 1), 2)
    x0, x1, x2 = (F.col(f"x{k}") for k in range(3))
    took = F.when(x1.isNull(), F.array(x0)).when(x2.isNull(), F.array(x1, x0)).otherwise(F.array(x2, x1, x0))
    return none.unionByName(read.select(*columns, took.alias("readings")))


def evidence(read: DataFrame, form: Column) -> DataFrame:
    """(book, form, places, with_one, none, mixed, langs, lang, reading, decided) from the readings beside each form's places.

    A place's readings count if they name one language; Japanese in a book on
    Korea only as kana, Korean in a book on Japan only as hangul. lang is the
    one language of all of a form's readings, decided whether every place has one.
    """
    r = F.col("readings")
    names = F.when(F.size(r) > 0, F.array_distinct(F.transform(r, lambda x: x["r"]))).otherwise(F.array().cast("array<string>"))
    one = F.when(F.size(names) == 1, names[0])
    masked = ((one == "ja") & (F.col("subject") == "korea") & ~F.exists(r, lambda x: x["kana"])) | ((one == "ko") & (F.col("subject") == "japan") & ~F.exists(r, lambda x: x["hangul"]))
    names = F.when(F.coalesce(masked, F.lit(False)), F.slice(names, 1, 0)).otherwise(names)
    rows = read.select("book", form.alias("form"), "doc_id", "at", "readings", names.alias("names"))
    n = lambda c: F.sum(c.cast("long"))
    out = rows.groupBy("book", "form").agg(
        F.count("*").alias("places"), n(F.size("names") == 1).alias("with_one"), n(F.size("names") == 0).alias("none"), n(F.size("names") > 1).alias("mixed"),
        *(F.max(F.array_contains("names", x)).alias(f"_{x}") for x in SUBJECTS),
    )
    # The few places with a reading alone are asked for their words.
    text = F.array_join(F.transform(r, lambda x: x["core"]), " ")
    first = rows.where(F.size("names") == 1).groupBy(F.col("book").alias("_book"), F.col("form").alias("_form")).agg(F.min_by(text, F.struct("doc_id", "at")).alias("reading"))
    out = out.join(first, F.col("book").eqNullSafe(F.col("_book")) & F.col("form").eqNullSafe(F.col("_form")), "left")
    langs = F.array_compact(F.array(*(F.when(F.col(f"_{x}"), x) for x in sorted(SUBJECTS))))
    out = out.select("book", "form", "places", "with_one", "none", "mixed", langs.alias("langs"), "reading")
    lang = F.when((F.size("langs") == 1) & (F.col("mixed") == 0), F.col("langs")[0])
    return out.withColumn("lang", lang).withColumn("langs", F.array_join("langs", ",")).withColumn("decided", F.col("lang").isNotNull() & (F.col("with_one") == F.col("places")))
