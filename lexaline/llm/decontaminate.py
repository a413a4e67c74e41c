"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units after a number, and names (capitalised words inside a sentence) become typed placeholders; all other words
stand in lower case. A capitalised word elsewhere may be a name or not: windows that hold one are searched both ways.
Items that differ in their slot values only are one class, which is searched once. Windows of template words of the
classes and of the documents are joined by hash, first by their keys alone, then, for documents that hold any of them,
with the values of their slots. Along one alignment of a document with a class, every placeholder of the item must
stand for one value: that of most of its windows. Windows without a placeholder and those that agree with it count, so
questions with other numbers or names are found, and chance alignments are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaline.llm.expressions import let
from lexaline.llm.storage import materialize

#: Template words in a window; items of fewer words are one window. Items of fewer than LEAST words can't be told from
#: chance inside a text: they count where they are a document's whole text, word for word.
WIDTH = 8
LEAST = 4
#: Share of an item's windows, or number of its windows, that makes a document contaminated (6 windows: 13 words).
SHARE = 0.5
RUN = 6
#: Benchmark windows up to which that side is broadcast (some 40 bytes each); beyond, both sides are shuffled.
BROADCAST_WINDOWS = 500_000
#: Documents up to which the table of those with a window in common is broadcast (some 100 bytes each).
BROADCAST_DOCUMENTS = 200_000
#: Words that are units when they follow a number.
UNITS = ("km", "m", "cm", "mm", "mi", "ft", "in", "kg", "g", "mg", "lb", "oz", "l", "ml", "s", "sec", "min", "h", "hr", "hours", "minutes", "seconds", "days", "weeks", "years", "meters", "metres", "miles", "feet", "inches", "pounds", "grams", "liters", "litres", "dollars", "cents", "euros", "usd", "eur", "percent", "degrees", "kmh", "mph")

_NAME_MARK = "\x01"
_NUMBER_MARK = "\x02"
_UNIT_MARK = "\x03"
#: A capitalised word that starts a text, sentence, line or quotation, or follows any other sign than those in a sentence.
_INITIAL_MARK = "\x04"
_WORD = r"[\p{L}\p{M}]+"
_NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)*"
_TOKEN = rf"[\x01-\x04]?(?:{_WORD}|{_NUMBER})"
#: Words of a text whose typed tokens have become single marks.
_TEMPLATE_TOKEN = rf"[\x01-\x03]|{_WORD}|{_NUMBER}"


_MARKS = _NAME_MARK + _NUMBER_MARK + _UNIT_MARK + _INITIAL_MARK
_CAPITALISED = r"(?<![\p{L}\p{M}\p{Nd}])\p{Lu}\p{Ll}"


def _plain(text: Column) -> Column:
    """The text without marks of its own; null counts as empty."""
    return F.when(F.rlike(text, F.lit(r"[\x01-\x04]")), F.translate(text, _MARKS, "    ")).otherwise(F.coalesce(text, F.lit("")))


def _marked(plain: Column) -> Column:
    """The text with a mark in front of every number, unit, name and possible name."""
    marked = F.regexp_replace(plain, r"(?<=[\p{Ll}\p{Nd},;:][ \t])(?=\p{Lu}\p{Ll})", _NAME_MARK)
    marked = F.regexp_replace(marked, r"(?<![\p{L}\p{M}\p{Nd}\x01])(?=\p{Lu}\p{Ll})", _INITIAL_MARK)
    units = "|".join(UNITS)
    with_units = F.regexp_replace(marked, rf"(?<=\p{{Nd}})([ \t]?)(?=(?i:{units})(?![\p{{L}}\p{{M}}]))", "$1 " + _UNIT_MARK)
    numbered = F.regexp_replace(with_units, r"(?<!\p{Nd})(?<!\p{Nd}[.,])(?=\p{Nd})", _NUMBER_MARK)
    return F.when(F.rlike(plain, F.lit("[0-9]")), numbered).otherwise(marked)


def _lower(words: Column) -> Column:
    """Lower case that doesn't depend on the letters around, so words and whole texts agree."""
    return F.lower(F.replace(words, F.lit("Σ"), F.lit("σ")))


def tokens(text: Column) -> Column:
    """Words of the text in order; numbers, units, names and possible names with a mark in front."""
    return F.regexp_extract_all(let(_plain(text), _marked), F.lit(_TOKEN), F.lit(0))


def _template(word: Column) -> Column:
    """Hash of the word in the template: of its mark, if it has one."""
    first = F.substring(word, 1, 1)
    return F.xxhash64(F.when(first.isin(_NAME_MARK, _NUMBER_MARK, _UNIT_MARK), first).otherwise(_lower(word)))


def _is_slot(word: Column) -> Column:
    return F.substring(word, 1, 1).isin(_NAME_MARK, _NUMBER_MARK, _UNIT_MARK)


def _key(template: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(template, at + j) for j in range(width)])


def _whole(words: Column) -> Column:
    """Key of a text of fewer than LEAST words, from the words as they are."""
    plain = F.transform(words, lambda w: _lower(F.translate(w, _MARKS, "")))
    return F.xxhash64(F.lit(0), F.array_join(plain, " "))


def _is_short(words: Column) -> Column:
    return (F.size(words) > 0) & (F.size(words) < LEAST)


def keys(text: Column, widths: list[int]) -> Column:
    """Keys of all windows of the text that :func:`windows` gives, without their places and slots; repeats included."""
    none = F.array().cast("array<bigint>")

    def of_width(t: Column, w: int) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(t) - w, F.lit(0)))
        return F.when(F.size(t) >= w, F.transform(at, lambda i: _key(t, i, w))).otherwise(none)

    def form(marked: Column) -> Column:
        words = F.regexp_extract_all(_lower(marked), F.lit(_TEMPLATE_TOKEN), F.lit(0))
        return let(F.transform(words, lambda x: F.xxhash64(x)), lambda t: F.concat(none, *[of_width(t, w) for w in widths]))

    def all_forms(marked: Column) -> Column:
        typed = F.regexp_replace(F.regexp_replace(marked, rf"\x02{_NUMBER}", _NUMBER_MARK), rf"\x03{_WORD}", _UNIT_MARK)
        named, initial = F.contains(marked, F.lit(_NAME_MARK)), F.contains(marked, F.lit(_INITIAL_MARK))

        def forms(t: Column) -> Column:
            bare = F.replace(t, F.lit(_INITIAL_MARK), F.lit(""))
            as_words = form(F.replace(bare, F.lit(_NAME_MARK), F.lit("")))
            all_named = form(F.regexp_replace(t, rf"[\x01\x04]{_WORD}", _NAME_MARK))
            inside_named = form(F.regexp_replace(bare, rf"\x01{_WORD}", _NAME_MARK))
            return F.concat(as_words, F.when(named | initial, all_named).otherwise(none), F.when(named & initial, inside_named).otherwise(none))

        return let(F.when(F.contains(marked, F.lit(_NUMBER_MARK)), typed).otherwise(marked), forms)

    def of(plain: Column) -> Column:
        # without digits and names inside sentences, capitals are the only marks
        marks = F.rlike(plain, F.lit(r"[0-9]|[\p{Ll}\p{Nd},;:][ \t]\p{Lu}\p{Ll}"))
        few = F.concat(form(plain), F.when(F.rlike(plain, F.lit(_CAPITALISED)), form(F.regexp_replace(plain, rf"{_CAPITALISED}[\p{{L}}\p{{M}}]*", _NAME_MARK))).otherwise(none))
        many_words = F.rlike(plain, F.lit(rf"\A[^\p{{L}}\p{{M}}\p{{Nd}}]*+(?:(?:[\p{{L}}\p{{M}}]++|\p{{Nd}}++(?:[.,]\p{{Nd}}++)*+)[^\p{{L}}\p{{M}}\p{{Nd}}]*+){{{LEAST}}}"))
        short = let(F.regexp_extract_all(_marked(plain), F.lit(_TOKEN), F.lit(0)), lambda w: F.when(_is_short(w), F.array(_whole(w))).otherwise(none))
        return F.concat(F.when(marks, let(_marked(plain), all_forms)).otherwise(few), F.when(many_words, none).otherwise(short))

    return let(_plain(text), of)


def _windows(words: Column, template: Column, slotted: Column, width: int, initial: Column | None = None) -> Column:
    """Structs (at, key, slots) of all windows of ``width`` template words, or of those that hold a place of ``initial``;
    slots are the values of the placeholders."""
    if initial is not None:
        last = F.size(template) - width
        reached = F.flatten(F.transform(initial, lambda i: F.when(last >= 0, F.sequence(F.least(F.greatest(i - (width - 1), F.lit(0)), last), F.least(i, last))).otherwise(F.array().cast("array<int>"))))
        at = F.array_distinct(reached)
    else:
        at = F.when(F.size(template) >= width, F.sequence(F.lit(0), F.size(template) - width)).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<string>")
    plain = F.transform(at, lambda i: F.struct(i.alias("at"), _key(template, i, width).alias("key"), none.alias("slots")))
    full = F.transform(at, lambda i: F.struct(i.alias("at"), _key(template, i, width).alias("key"), F.transform(F.filter(F.slice(words, i + 1, width), _is_slot), _lower).alias("slots")))
    return F.when(slotted, full).otherwise(plain)


def windows(text: Column, widths: list[int]) -> Column:
    """All windows of the text, of each of the ``widths``, and the one of a text of fewer than LEAST words; null counts
    as empty."""
    none = F.array().cast("array<struct<at:int,key:bigint,slots:array<string>>>")

    def all_widths(words: Column, slotted: Column, initial: Column | None = None) -> Column:
        return let(F.transform(words, _template), lambda t: F.concat(none, *[_windows(words, t, slotted, w, initial) for w in widths]))

    def of(marked: Column) -> Column:
        places = F.filter(F.transform(marked, lambda w, i: F.when(F.substring(w, 1, 1) == _INITIAL_MARK, i)), F.isnotnull)
        as_names = let(F.transform(marked, lambda w: F.translate(w, _INITIAL_MARK, _NAME_MARK)), lambda n: let(places, lambda i: all_widths(n, F.lit(True), i)))
        as_words = let(F.transform(marked, lambda w: F.ltrim(w, F.lit(_INITIAL_MARK))), named_or_not)
        short = F.array(F.struct(F.lit(0).alias("at"), _whole(marked).alias("key"), F.array().cast("array<string>").alias("slots")))
        found = F.when(F.exists(marked, lambda w: F.substring(w, 1, 1) == _INITIAL_MARK), F.concat(as_words, as_names)).otherwise(as_words)
        return F.concat(found, F.when(_is_short(marked), short).otherwise(none))

    def named_or_not(words: Column) -> Column:
        named = F.exists(words, lambda w: F.substring(w, 1, 1) == _NAME_MARK)
        typed = all_widths(words, F.exists(words, _is_slot))
        # the same with names as plain words: a capital may be all that differs
        plain = let(F.transform(words, lambda w: F.ltrim(w, F.lit(_NAME_MARK))), lambda p: all_widths(p, F.exists(p, _is_slot)))
        return F.when(named, F.concat(typed, plain)).otherwise(typed)

    return let(tokens(text), of)


def classes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """(rows (item, text, class, n_windows, windows), widths): the items without repeated rows, their class, and its windows.

    Two items are of one class if their windows are equal but for the values of the slots, of which only the order of
    first occurrence counts: then no document matches one of them alone. Null texts and texts without words are left out.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    length = F.size(tokens(F.col("text")))
    sized = materialize(items.select("item", "text", F.least(length, F.lit(WIDTH)).alias("width")).where("width > 0"), "leaks-items")
    widths = sorted(r["width"] for r in sized.select("width").distinct().collect())
    values = F.array_distinct(F.transform(F.filter(tokens(F.col("text")), lambda w: _is_slot(w) | (F.substring(w, 1, 1) == _INITIAL_MARK)), lambda w: _lower(F.translate(w, _MARKS, ""))))
    made = None
    for width in widths:
        own = sized.where(F.col("width") == width).select("item", "text", windows(F.col("text"), [width] if width >= LEAST else []).alias("w"), values.alias("v"))
        made = own if made is None else made.unionByName(own)
    if made is None:
        made = sized.select("item", "text", windows(F.col("text"), []).alias("w"), values.alias("v"))
    plain = lambda s: F.translate(s, _NAME_MARK + _NUMBER_MARK + _UNIT_MARK, "")
    numbered = F.transform("w", lambda x: F.struct(x["at"].alias("item_at"), x["key"].alias("key"), F.transform(x["slots"], lambda s: F.array_position(F.col("v"), plain(s)).cast("int")).alias("item_slots")))
    rows = made.select("item", "text", F.array_sort(F.array_distinct(numbered)).alias("windows"))
    same = F.sha2(F.to_json("windows"), 256)
    return rows.select("item", "text", same.alias("class"), F.size(F.array_distinct(F.transform("windows", lambda x: x["item_at"]))).cast("long").alias("n_windows"), "windows"), [w for w in widths if w >= LEAST]


def _consistent(seen: Column) -> Column:
    """Places of the windows of one alignment, ``seen(place, pairs)``, in which every placeholder stands for the value that
    it has in most windows of the alignment; of equally frequent values the least."""

    def of(pairs: Column) -> Column:
        distinct = F.array_distinct(pairs)

        def without_losers() -> Column:
            ranked = F.transform(distinct, lambda p: F.struct((-F.size(F.filter(pairs, lambda x: x == p))).alias("n"), p["b"].alias("b"), p["a"].alias("a")))
            losers = let(ranked, lambda all_: F.transform(F.filter(all_, lambda p: F.exists(all_, lambda q: (q["a"] == p["a"]) & (q < p))), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"))))
            return let(losers, lambda lost: F.filter(seen, lambda w: ~F.arrays_overlap(w["pairs"], lost)))

        agreed = F.size(distinct) == F.size(F.array_distinct(F.transform(distinct, lambda p: p["a"])))
        return F.transform(F.when(agreed, seen).otherwise(without_losers()), lambda w: w["place"])

    return let(F.flatten(F.transform(seen, lambda w: w["pairs"])), of)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Rows (id, text_hash, item, n_items, n_matched, n_windows, share) for each document and class of items with a
    consistent match. ``item`` is the least id of the class, of which ``n_items`` rows of the benchmark are.

    ``benchmark(item_id, text)``; items with null ids are searched like any other. Null texts count as empty and match
    nothing; repeated rows are one; null ids are kept apart by their texts; other columns are ignored. Empty tables give
    an empty result.
    """
    made, widths = classes(benchmark, item_col)
    grouped = made.groupBy("class").agg(F.min("item").alias("item"), F.count("*").alias("n_items"), F.min("n_windows").alias("n_windows"), F.first("windows").alias("windows"))
    known = materialize(grouped, "leaks-classes")
    wanted = materialize(known.select("class", F.explode("windows").alias("w")).select("class", "w.*"), "leaks-windows")
    small = wanted.count() <= BROADCAST_WINDOWS
    sized = F.broadcast if small else (lambda df: df)

    text_hash = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), text_hash.alias("text_hash"), F.col(text_col).alias("text"))
    held = rows.select("id", "text_hash", F.explode(keys(F.col("text"), widths)).alias("key"))
    held = materialize(held.join(sized(wanted.select("key").distinct()), "key", "left_semi").select("id", "text_hash").distinct(), "leaks-candidates")
    few = F.broadcast if held.count() <= BROADCAST_DOCUMENTS else (lambda df: df)
    held = few(held.select(F.col("id").alias("held_id"), F.col("text_hash").alias("held_hash")))
    looked = rows.join(held, F.col("id").eqNullSafe(F.col("held_id")) & (F.col("text_hash") == F.col("held_hash")), "left_semi").dropDuplicates(["id", "text_hash"])

    found = looked.select("id", "text_hash", F.explode(windows(F.col("text"), widths)).alias("w"))
    found = found.select("id", "text_hash", F.col("w.at").alias("at"), F.col("w.key").alias("key"), F.col("w.slots").alias("slots"))
    hits = found.join(sized(wanted), "key").where(F.size("slots") == F.size("item_slots"))
    # one alignment: the same distance between the places in the document and in the item
    pairs = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    aligned = hits.groupBy("id", "text_hash", "class", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set(F.struct(F.col("item_at").alias("place"), pairs.alias("pairs"))).alias("seen"))
    placed = aligned.select("id", "text_hash", "class", F.explode(_consistent(F.col("seen"))).alias("place")).groupBy("id", "text_hash", "class").agg(F.count_distinct("place").alias("n_matched"))
    scored = placed.join(sized(known.select("class", "item", "n_items", "n_windows")), "class")
    return scored.select(F.col("id").alias(id_col), "text_hash", "item", "n_items", "n_matched", "n_windows", (F.col("n_matched") / F.col("n_windows")).alias("share"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The matches that make a document contaminated: half of an item's windows, or as many as 13 words in a row have."""
    return matches(docs, benchmark, id_col, text_col).where((F.col("share") >= SHARE) | (F.col("n_matched") >= RUN))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents; all columns come back, whatever their names.

    Null and empty texts stay; of rows with one id only those with the contaminated text go, repeated rows together. An
    empty table or benchmark leaves ``docs`` as it is.
    """
    bad = contaminated(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    bad = materialize(bad, "leaks-found")
    hashed = F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary"))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["bad_id"]) & (hashed == bad["bad_hash"]), "left_anti")
