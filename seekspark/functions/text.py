"""Column functions on text: tokens, titles, documents, keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word of any script; Java's \w would be ASCII only.
WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-cased words of the text, repeats kept; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def char_bigrams(text: Column) -> Column:
    """Overlapping character pairs of each word; a word of one character stays."""
    pairs = lambda w: F.when(F.length(w) == 1, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2))))
    return F.flatten(F.transform(tokens(text), pairs))


Tokenizer = Callable[[Column], Column]
TOKENIZERS: dict[str, Tokenizer] = {"word": tokens, "char2": char_bigrams}


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def decade(year: Column, suffix: str = "s") -> Column:
    """1994 to "1990s"; null for null and 0."""
    return F.when(year != 0, F.concat((F.floor(year / 10) * 10).cast("string"), F.lit(suffix)))


def search_document(caption_ko: Column, caption_en: Column, place: Column, objects: Column, genres: Column, year: Column) -> Column:
    """The text that is indexed for a scene, a line for each filled field. Titles and text in the picture stay out."""
    listed = lambda a: F.nullif(F.array_join(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != ""), ", "), F.lit(""))
    labelled = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws("\n", _filled(caption_ko), _filled(caption_en), labelled("장소", _filled(place)), labelled("물건", listed(objects)), labelled("장르", listed(genres)), labelled("연대", decade(year, "년대")))


def movie_document(plot: Column, keywords: Column) -> Column:
    """Plot, then the keywords; empty parts are left out."""
    return F.concat_ws("\n", F.nullif(plot, F.lit("")), F.nullif(F.array_join(keywords, ", "), F.lit("")))


def caption_for(lang: str, caption_ko: Column, caption_en: Column) -> Column:
    """The caption in a variant's language: ko, en (ko where it is missing) or both."""
    if lang == "ko":
        return caption_ko
    if lang == "en":
        return F.coalesce(_filled(caption_en), caption_ko)
    if lang == "both":
        return F.concat_ws("\n", _filled(caption_ko), _filled(caption_en))
    raise ValueError(f"no document language {lang}")


def retrieval_text(scene: Column, keywords: Column) -> Column:
    return F.trim(F.concat_ws(" ", scene, F.array_join(keywords, " ")))


def text_hash(model: str, dim: int, text: Column) -> Column:
    """Key under which a text's vector is kept."""
    return F.sha1(F.concat_ws("|", F.lit(model), F.lit(str(dim)), text))


def uuid5(namespace: str, key: Column) -> Column:
    """RFC 4122 name-based identifier (version 5) of key."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(key, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def hash64(hexed: Column) -> Column:
    """16 hex digits as a signed 64-bit number."""
    return F.conv(hexed, 16, -10).cast("long")


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def normalized_title(title: Column, *, volumes: bool = True) -> Column:
    """Comparable form of a title: search marks, punctuation and blanks dropped, lower case; "volume" is "vol"."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(title, "!H[SE]", ""), r"[^\p{L}\p{N}]+", ""))
    return F.replace(plain, F.lit("volume"), F.lit("vol")) if volumes else plain


def title_variants(*names: Column, others: Column | None = None) -> Column:
    """Normalised forms of all names, of the ^-separated others, and of each without a trailing (...)."""
    raw = F.array(*names)
    if others is not None:
        raw = F.concat(raw, F.coalesce(F.split(others, r"\^"), F.array().cast("array<string>")))
    both = F.concat(raw, F.transform(raw, lambda t: F.regexp_replace(t, r"\s*\([^)]*\)\s*$", "")))
    return F.array_distinct(F.filter(F.transform(both, lambda t: normalized_title(t)), lambda t: t.isNotNull() & (t != "")))


def keyword_list(joined: Column) -> Column:
    """Comma-separated keywords: trimmed, empty ones dropped, repeats dropped, order kept."""
    return F.array_distinct(F.filter(F.transform(F.split(joined, ","), lambda k: F.trim(k)), lambda k: k != ""))


def years_of(*dates: Column) -> Column:
    """The years that the fields begin with."""
    return F.array_distinct(F.array_compact(F.array(*(F.nullif(F.regexp_extract(d, r"^(\d{4})", 1), F.lit("")).cast("int") for d in dates))))


def scene_id(movie: Column, source: Column, n: Column) -> Column:
    return F.concat_ws("_", movie, source, n)


def scene_parts(scene: Column) -> list[Column]:
    """movie, source and n of a scene id."""
    parts = F.split(scene, "_")
    return [F.get(parts, F.lit(k)) for k in range(3)]


def thumb_key(scene: Column) -> Column:
    return F.concat(F.lit("thumbs/"), scene, F.lit(".jpg"))


def thumb_url(base: str | None, key: Column) -> Column:
    return F.concat_ws("/", F.lit(base.rstrip("/")), key) if base else F.lit(None).cast("string")


def korean_plot(plots: Column) -> Column:
    """The text of the first Korean plot that isn't blank, trimmed, of an array of structs with plotLang and plotText; else null."""
    white = F.lit(" \t\n\r\x0b\x0c")
    filled = F.filter(plots, lambda p: (p["plotLang"] == "한국어") & (F.btrim(F.coalesce(p["plotText"], F.lit("")), white) != ""))
    return F.btrim(F.get(filled, F.lit(0))["plotText"], white)


def from_caption(caption: Column) -> Column:
    """A rewritten query of a picture's caption: both sentences, its place and objects as keywords, no filter."""
    filled = lambda a: F.filter(a, lambda x: x.isNotNull() & (x != ""))
    words = F.concat(F.array(caption["setting"]), F.coalesce(caption["objects"], F.array().cast("array<string>")))
    return F.struct(F.array_join(filled(F.array(caption["caption_ko"], caption["caption_en"])), " ").alias("scene_ko"), filled(words).alias("keywords_ko"), F.expr("cast(map() as map<string,string>)").alias("soft_filters"))


def has_query(text: Column, caption: Column) -> Column:
    """Whether there is anything to search for: a text that isn't blank, or a caption."""
    return (F.trim(F.coalesce(text, F.lit(""))) != "") | caption.isNotNull()


def rewritten_or_raw(rewritten: Column, text: Column, caption_ko: Column) -> Column:
    """The rewritten query; where there is none, or it has no scene, the user's text, else the caption, stands for its scene."""
    raw = F.coalesce(F.nullif(text, F.lit("")), caption_ko, F.lit(""))
    scene = F.coalesce(F.nullif(rewritten["scene_ko"], F.lit("")), raw)
    return F.struct(scene.alias("scene_ko"), F.coalesce(rewritten["keywords_ko"], F.array().cast("array<string>")).alias("keywords_ko"), F.coalesce(rewritten["soft_filters"], F.expr("cast(map() as map<string,string>)")).alias("soft_filters"))


# Particles at a word's end, in the order in which they are tried, and words that nearly every query has.
PARTICLES = (
    "에서는", "으로는", "에서", "으로", "에게", "까지", "부터", "처럼", "하고", "이랑", "랑", "은",
    "는", "이", "가", "을", "를", "에", "로", "와", "과", "도", "의", "만",
)
COMMON_WORDS = (
    "장면", "영화", "안에서", "안에", "같은데", "같아요", "기억", "있었는데", "있던", "나오던",
    "나오는", "하던", "있는", "그리고", "어떤", "누군가",
)


def query_terms(query: Column) -> Column:
    """The words of a query that are worth marking: without their particle (if two letters stay), common words dropped, order kept."""
    words = F.filter(F.split(query, r"[\s,.!?~·]+"), lambda w: w != "")
    particles = F.array(*map(F.lit, PARTICLES))
    common = list(COMMON_WORDS)

    def bare(w: Column) -> Column:
        own = F.get(F.filter(particles, lambda p: (F.length(w) > F.length(p)) & F.endswith(w, p)), F.lit(0))
        left = F.length(w) - F.length(own)
        return F.when(left >= 2, F.substr(w, F.lit(1), left)).otherwise(w)

    pairs = F.transform(words, lambda w: F.struct(w.alias("raw"), bare(w).alias("word")))
    kept = F.filter(pairs, lambda p: (F.length(p["word"]) >= 2) & ~p["word"].isin(common) & ~p["raw"].isin(common))
    return F.array_distinct(F.transform(kept, lambda p: p["word"]))


def highlighted(caption: Column, terms: Column) -> Column:
    """array<struct<text, match>>: the caption cut where terms begin and end, of several the longest; whole if there is no term."""
    mark = "\ufdd0"  # no character; it stands for the cuts
    longest = F.array_sort(terms, lambda a, b: F.length(b) - F.length(a))
    pattern = F.concat(F.lit("("), F.array_join(F.transform(longest, lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), "|"), F.lit(")"))
    parts = F.split(F.regexp_replace(caption, pattern, F.lit(f"{mark}$1{mark}")), mark)
    found = F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("text"), (i % 2 == 1).alias("match"))), lambda x: x["text"] != "")
    return F.when(F.size(terms) > 0, found).otherwise(F.array(F.struct(caption.alias("text"), F.lit(False).alias("match"))))


def redacted_images(json: Column) -> Column:
    """Inline pictures in a JSON text replaced by a mark."""
    return F.regexp_replace(json, r'data:image/[^"\\]*', "[image]")


def overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct tokens that b has; 0 if a has none."""
    own = F.array_distinct(a)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(own, b)).cast("double"), F.size(own).cast("double")), F.lit(0.0))


def natural_order(name: Column) -> list[Column]:
    """Sort keys with numbers by value: E2 before E10."""
    return [F.regexp_extract(name, r"^(\D*)", 1), F.coalesce(F.nullif(F.regexp_extract(name, r"^\D*(\d+)", 1), F.lit("")).cast("long"), F.lit(-1)), name]


def significant(value: Column, digits: int = 2) -> Column:
    """value rounded to so many significant digits; 0 and null stay."""
    power = F.floor(F.log10(F.abs(F.nullif(value, F.lit(0.0)))))
    factor = F.pow(F.lit(10.0), F.lit(digits - 1) - power)
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value * factor) / factor)
