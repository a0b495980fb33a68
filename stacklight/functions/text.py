"""Text normalisation of bibliographic fields, as Column -> Column functions that stay in whole-stage code generation."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language codes that say nothing, in natural order (fixed values).
NO_LANGUAGES = ["mis", "mul", "sgn", "und", "xxx", "zxx"]
#: Articles that a canonical key leaves out, in natural order (fixed values).
ARTICLES = ["the", "a", "an", "le", "la", "les", "un", "une", "des"]
#: Latin, Greek and Cyrillic letters with a canonical decomposition to a base letter, and those base letters.
_ACCENTED = [chr(c) for lo, hi in ((0xC0, 0x250), (0x370, 0x500), (0x1E00, 0x2000)) for c in range(lo, hi) if len(unicodedata.normalize("NFD", chr(c))) > 1 and unicodedata.category(chr(c)) == "Ll" and chr(c) not in "ǣǽǿ"]
_BASES = [unicodedata.normalize("NFD", c)[0] for c in _ACCENTED]
#: Letters without such a decomposition, and what they fold to (fixed values).
PLAIN_LETTERS = {"đ": "d", "ð": "d", "ħ": "h", "ı": "i", "ł": "l", "ø": "o", "ǿ": "o", "ŧ": "t", "ſ": "s"}
LETTER_PAIRS = {"ß": "ss", "æ": "ae", "ǣ": "ae", "ǽ": "ae", "ĳ": "ij", "œ": "oe", "þ": "th"}
#: White space, in the order of its code points (fixed value).
WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Designations of character sets and other escapes of ISO 2022, and what XML 1.0 forbids (fixed values).
ESCAPES = r"""\x1b(?:\$?[()*+][A-Za-z0-9!"#$%&'-]|[@-_])"""
ILLEGAL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
#: Trailing punctuation and space of ISBD, but the full stop of an initial.
ISBD_END = r"(?<!(?<![A-Za-z])[A-Z](?=\.))[\s:/;,=.]+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.trim(c, F.lit(WHITE))


def nullify(c: Column) -> Column:
    """Empty as null."""
    return F.when(c != "", c)


def strip_isbd(c: Column) -> Column:
    """Without trailing ISBD punctuation and space; the full stop of an initial stays."""
    return F.regexp_replace(c, ISBD_END, "")


def clean_isbn(c: Column) -> Column:
    """Bare upper-case ISBN of 10 or 13 characters, else null; what follows a bracket is a remark."""
    bare = F.upper(F.regexp_replace(F.substring_index(c, "(", 1), "[^0-9Xx]", ""))
    return F.when(F.length(bare).isin(10, 13), bare)


def split_isbns(c: Column) -> Column:
    """All ISBN-like runs of a field that separates them by bars or spaces."""
    parts = F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", " "), r"\s+"), lambda p: F.regexp_replace(p, "[^0-9A-Za-z]", ""))
    return F.filter(parts, lambda p: F.length(p).between(10, 13))


def isbn13s(c: Column) -> Column:
    """The ISBN-13s of an array, dashes dropped."""
    return F.filter(F.transform(c, lambda p: F.regexp_replace(p, "-", "")), lambda p: p.rlike("^[0-9]{13}$"))


def isbn_shaped(c: Column) -> Column:
    """The query's bare form if it looks like an ISBN, else null."""
    bare = F.regexp_replace(c, "[^0-9A-Za-z]", "")
    return F.when(bare.rlike("^[0-9]{9}([0-9]{3})?[0-9A-Za-z]$"), F.upper(bare))


def strip_nonfiling(c: Column) -> Column:
    """A leading bracket of up to 12 characters (a nonfiling article) unwrapped."""
    return F.ltrim(F.regexp_replace(c, r"^\[([^\]]{0,12})\]", "$1"))


def join_parts(parts: Column, sep: str) -> Column:
    """The non-blank parts of an array, trimmed and joined."""
    return F.array_join(F.filter(F.transform(parts, lambda p: strip(p)), lambda p: p != ""), sep)


def extract_year(c: Column) -> Column:
    """The first year from 1000 to 2099 that stands alone, or null."""
    return nullify(F.regexp_extract(c, "(?<![0-9])(1[0-9]{3}|20[0-9]{2})(?![0-9])", 1)).cast("smallint")


def edition_year(c: Column) -> Column:
    """The first year from 1500 to 2029 in free text."""
    return nullify(F.regexp_extract(c, "(1[5-9][0-9]{2}|20[0-2][0-9])", 1)).cast("smallint")


def leading_year(*cs: Column) -> Column:
    """The first four characters of the first non-empty value, if a number."""
    return F.left(F.coalesce(*[nullify(strip(c)) for c in cs]), F.lit(4)).try_cast("smallint")


def merge_subtitle(title: Column, subtitle: Column) -> Column:
    """title : subtitle, unless the title already holds it; without a title, the subtitle."""
    head, sub = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(subtitle, F.lit("")))
    return F.when((sub == "") | F.contains(F.lower(head), F.lower(sub)), head).when(head == "", sub).otherwise(F.concat(head, F.lit(" : "), sub))


def biblionumber(record_id: Column) -> Column:
    """What follows the last colon."""
    return F.split_part(record_id, F.lit(":"), F.lit(-1))


def fold(c: Column) -> Column:
    """Lower case without accents; a letter of two letters, as œ, becomes both."""
    out = F.translate(F.lower(c), "".join([*_ACCENTED, *PLAIN_LETTERS]), "".join([*_BASES, *PLAIN_LETTERS.values()]))
    for letter, pair in LETTER_PAIRS.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return out


def searchable_authors(authors: Column) -> Column:
    return fold(F.array_join(authors, " "))


def canonical_key(title: Column, authors: Column) -> Column:
    """A key that editions of one work share: title without punctuation and leading article, and the first author."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    bare = F.regexp_replace(plain(F.coalesce(title, F.lit(""))), f"^({'|'.join(ARTICLES)}) ", "")
    return F.concat(bare, F.lit("|"), plain(F.coalesce(F.get(authors, F.lit(0)), F.lit(""))))


def subject_head(c: Column) -> Column:
    return F.get(F.split(c, r"\s+(?:--|—)\s+"), F.lit(0))


def clip(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def clip_each(c: Column, n: int) -> Column:
    return F.transform(c, lambda x: F.left(x, F.lit(n)))


def is_current(back: Column) -> Column:
    """Whether a loan is still out."""
    return back.isNull()


def iso_time(c: Column) -> Column:
    """A timestamp as ISO 8601 in UTC with its offset, whatever the session's zone is; null as null."""
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.unix_seconds(c))
    rest = F.pmod(F.unix_micros(c), F.lit(1_000_000))
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.when(rest != 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def or_empty(c: Column, trimmed: bool = False) -> Column:
    """A null array as an empty one, its strings trimmed on request."""
    full = F.coalesce(c, F.array().cast("array<string>"))
    return F.transform(full, lambda x: strip(x)) if trimmed else full


def pair_linked(links: Column) -> Column:
    """An array of linkage values of 880 fields -> map from "tag-occurrence" to the place of the first field that links there;
    malformed and standalone ones are left out."""
    at = F.transform(links, lambda x, i: F.struct(parse_linkage(x).alias("l"), i.alias("i")))
    good = F.filter(at, lambda x: x["l"].isNotNull() & ~x["l"]["standalone"])
    keyed = F.transform(good, lambda x: F.struct(F.concat_ws("-", x["l"]["tag"], x["l"]["occurrence"]).alias("key"), x["i"].alias("value")))
    first = F.filter(keyed, lambda x, i: ~F.exists(F.slice(keyed, F.lit(1), i), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(first)


def days_held(out: Column, back: Column) -> Column:
    return (F.unix_timestamp(back) - F.unix_timestamp(out)) / 86400


def clean_query(c: Column) -> Column:
    """A catalogue query string without index prefixes and quotes."""
    bare = F.regexp_replace(F.regexp_replace(c, r"\b[A-Za-z-]+(?:,[A-Za-z-]+)*[:=]", " "), r"[\"']", " ")
    return strip(F.regexp_replace(bare, r"\s+", " "))


def result_count(html: Column) -> Column:
    """The number of hits that a search page states; -1 if it states none."""
    n = F.regexp_replace(F.regexp_extract(html, r"returned ([0-9,]+) result", 1), ",", "")
    return F.when(F.contains(html, F.lit("No results found")), 0).when(n != "", n.try_cast("int")).otherwise(-1)


def transpose_typo(c: Column) -> Column:
    """The longest word with its two middle characters exchanged."""
    words = F.split(c, " ")
    longest = F.array_max(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))["w"]
    at = F.floor(F.length(longest) / 2).cast("int")
    bad = F.concat(F.left(longest, at - 1), F.substr(longest, at + 1, F.lit(1)), F.substr(longest, at, F.lit(1)), F.substr(longest, at + 2))
    return F.array_join(F.transform(words, lambda w: F.when((w == longest) & (F.length(w) > 3), bad).otherwise(w)), " ")


def source_name(url: Column) -> Column:
    """The host (and port) of a URL."""
    return F.split_part(F.split_part(url, F.lit("//"), F.lit(-1)), F.lit("/"), F.lit(1))


def parse_headers(lines: Column) -> Column:
    """NAME:VALUE strings as a map; a line without a colon is an error."""
    pair = lambda x: F.split(x, ":", 2)
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(strip(pair(x)[0]), F.coalesce(strip(F.get(pair(x), F.lit(1))), F.raise_error(F.concat(F.lit("no colon in header: "), x)).cast("string")))))


def merge_maps(old: Column, new: Column) -> Column:
    """Entries of both, new ones winning."""
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_concat(kept, new))


def surname(name: Column) -> Column:
    return F.element_at(F.split(strip(name), r"\s+"), -1)


def forename(name: Column) -> Column:
    return F.trim(F.regexp_replace(strip(name), r"\S+$", ""))


def article_length(title: Column, language: Column) -> Column:
    """Characters of a leading article with its space, by language."""
    pattern = F.when(language == "eng", "^(the|an|a) ").when(language == "fre", "^(l['’]|le |la |les |un |une |des )").when(language == "ger", "^(der|die|das|ein|eine) ").when(language == "spa", "^(el|la|los|las|un|una) ")
    return F.coalesce(F.length(F.regexp_substr(F.lower(title), pattern)), F.lit(0))


def first_accepted(paths: Column, accepted: list[str]) -> Column:
    """The first accepted last path segment."""
    last = F.transform(paths, lambda p: F.split_part(p, F.lit("/"), F.lit(-1)))
    return F.get(F.filter(last, lambda x: x.isin(accepted)), F.lit(0))


def text_value(json: Column, field: str) -> Column:
    """A field that holds a string or an object with a value."""
    return F.coalesce(F.get_json_object(json, f"$.{field}.value"), F.get_json_object(json, f"$.{field}"))


def is_latin(c: Column) -> Column:
    return 2 * F.regexp_count(c, F.lit(r"\p{IsLatin}")) >= F.regexp_count(c, F.lit(r"\p{L}"))


def prefer_script(primary: Column, alternate: Column) -> Column:
    """(embed, search): the non-Latin form is embedded, both are searched; ties keep the primary; a blank one leaves the other."""
    one, alt = F.coalesce(primary, F.lit("")), F.coalesce(alternate, F.lit(""))
    no_one, no_alt = strip(one) == "", strip(alt) == ""
    embed = F.when(no_alt, one).when(no_one | (is_latin(one) & ~is_latin(alt)), alt).otherwise(one)
    return F.struct(embed.alias("embed"), F.when(no_alt, one).when(no_one, alt).otherwise(F.concat_ws(" ", one, alt)).alias("search"))


def parse_linkage(c: Column) -> Column:
    """tag, occurrence, script and orientation of a linking subfield; null if malformed. Occurrence 00 links to nothing."""
    pattern = r"^([0-9]{3})-([0-9]{2})(?:/([^/]+)(?:/(.+))?)?$"
    part = lambda i: F.regexp_extract(c, pattern, i)
    return F.when(c.rlike(pattern), F.struct(part(1).alias("tag"), part(2).alias("occurrence"), nullify(part(3)).alias("script"), nullify(part(4)).alias("orientation"), (part(2) == "00").alias("standalone")))


def language_chunks(c: Column) -> Column:
    """Three-letter codes run together, lower case; a length that isn't a multiple of three is junk."""
    s = F.lower(strip(c))
    n = F.length(s)
    return F.when((n > 0) & (n % 3 == 0), F.transform(F.sequence(F.lit(0), n - 3, F.lit(3)), lambda i: F.substr(s, i + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def accepted_languages(codes: Column) -> Column:
    """Distinct well-formed codes that name a language."""
    return F.array_except(F.array_distinct(F.filter(codes, lambda x: x.rlike("^[a-z]{3}$"))), F.array(*[F.lit(x) for x in NO_LANGUAGES]))


def language_chain(a101: Column, a041: Column, f008: Column) -> Column:
    """Languages from 101$a, else 041$a (arrays of values), else positions 35 to 37 of 008."""
    from_values = lambda vs: accepted_languages(F.flatten(F.transform(F.coalesce(vs, F.array().cast("array<string>")), language_chunks)))
    fixed = accepted_languages(F.when(F.length(f008) >= 38, F.array(F.lower(F.substring(f008, 36, 3)))).otherwise(F.array().cast("array<string>")))
    some = lambda x: F.when(F.size(x) > 0, x)
    return F.coalesce(some(from_values(a101)), some(from_values(a041)), fixed)


def build_text(title: Column, alternate: Column, subjects: Column, summary: Column, contents: Column) -> Column:
    """What is encoded of a work: core, description, and whether only a title is known."""
    blank = lambda c: nullify(strip(F.coalesce(c, F.lit(""))))
    subs = F.filter(F.coalesce(subjects, F.array().cast("array<string>")), lambda s: strip(s) != "")
    core = F.concat_ws(". ", blank(prefer_script(title, alternate)["embed"]), subs)
    description = F.concat_ws(". ", blank(summary), blank(contents))
    return F.struct(core.alias("core"), description.alias("description"), ((description == "") & (F.size(subs) == 0)).alias("is_title_only"))


def sanitize_xml(c: Column) -> Column:
    """Text without ISO 2022 escapes and characters that XML forbids, and how many of them went."""
    once = F.regexp_replace(c, ESCAPES, "")
    return F.struct(F.regexp_replace(once, ILLEGAL, "").alias("text"), (F.regexp_count(c, F.lit(ESCAPES)) + F.regexp_count(once, F.lit(ILLEGAL))).alias("removed"))


def gram_sequence(folded: Column) -> Column:
    """The trigrams of a folded text's alphanumeric words in order, each word padded by two blanks before and one after."""
    words = F.filter(F.split(folded, r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.flatten(F.transform(words, grams))


def trigrams(c: Column) -> Column:
    """The distinct trigrams of a text."""
    return F.array_distinct(gram_sequence(fold(c)))


def similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct trigrams of two trigram arrays."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every > 0, shared / every).otherwise(0.0)
