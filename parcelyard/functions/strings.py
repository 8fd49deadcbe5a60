"""Text of listings: names of areas and streets, descriptions, dirty values."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values, all lists down to MONTHS: spaces that don't break, as characters and as they come escaped; words that name no area; names that go together, and names that take sparse ones; phrases of descriptions.
NBSP = ("\u00a0", "\u202f", "\u2009", "\ufeff")
NBSP_ESCAPED = ("\\xa0", "\\u202f", "\\u00a0", "&nbsp;")
GENERIC = ("stockholm", "stockholms län", "stockholms kommun", "stockholms stad", "län", "kommun", "stad", "lägenhet", "villa", "radhus", "bostadsrätt")
CONSOLIDATED = {"Solna kommun": "Solna", "Frösunda": "Solna", "Sundbyberg/Duvbo": "Sundbyberg", "Sundbybergs kommun": "Sundbyberg", "Rissne/Ursvik": "Sundbyberg", "Kristineberg": "Kungsholmen"}
SPELLING = {"Vasasatan": "Vasastan", "Kungholmen": "Kungsholmen", "Östemalm": "Östermalm", "Strockholm": "Stockholm", "Hagastan": "Hagastaden"}
DISTRICTS = ("Vasastan", "Kungsholmen", "Södermalm", "Östermalm", "Norrmalm")
TOGETHER = {
    "Vasastan Birkastan": "Birkastan", "Maria": "Södermalm Maria", "Sofia": "Södermalm Sofia", "Stockholm Södermalm": "Södermalm", "Gärdet Östermalm": "Gärdet", "Nedre Gärdet": "Gärdet", "Nedre Gärdet Östermalm": "Gärdet",
    "Nacka Kommun": "Nacka", "Fridhemsplan": "Kungsholmen Fridhemsplan", "Mariaberget": "Södermalm", "Nytorget": "Södermalm", "Sofo": "Södermalm Sofia", "Thorildsplan": "Kungsholmen", "City": "Norrmalm", "Hägersten-Liljeholmen": "Liljeholmen",
    "Kungsholmstorg": "Kungsholmen", "Mariatorget": "Södermalm Maria", "Katarina": "Södermalm Katarina", "Norr Mälarstrand": "Kungsholmen", "Odenplan": "Vasastan Odenplan", "Alvik": "Bromma", "Rådhusparken": "Kungsholmen", "Årstaberg": "Årsta",
    "Traneberg": "Bromma", "Minneberg": "Bromma", "Gullmarsplan": "Johanneshov", "Atlas": "Vasastan", "Globen": "Årsta", "Hjorthagen": "Gärdet", "Högst Upp": "Södermalm", "Högalid": "Södermalm Högalid", "Kronobergsparken": "Kungsholmen",
    "Lindhagen": "Kungsholmen", "Mosebacke": "Södermalm", "Norra Djurgården": "Gärdet", "Norra Djurgårdstaden": "Norra Djurgårdsstaden", "Nybodahöjden": "Södermalm", "Ruddammen": "Bromma", "Rådhuset": "Kungsholmen", "Röda Bergen": "Vasastan",
    "Rödabergen": "Vasastan", "Vasastan Rödabergen": "Vasastan", "Rörstrand": "Vasastan", "Sibirien": "Vasastan", "Sibrien": "Vasastan", "Eget": "Hammarby Sjöstad", "Centrum": "Norrmalm", "Stadshagen": "Kungsholmen", "Sveakvarteren": "Vasastan",
    "Södra Station": "Södermalm", "Stockholm": "Stockholms län", "Kungsholmen Kungsholms Strand": "Kungsholmen", "Kungsholmen Nedre": "Kungsholmen", "Nedre Kungsholmen": "Kungsholmen",
}
PARENTS = ("Vasastan", "Kungsholmen", "Södermalm", "Östermalm", "Norrmalm", "Bromma", "Gärdet", "Hammarby Sjöstad")
RENOVATED = ("nyrenoverad", "nyrenoverat", "renoverad", "renoverat", "totalrenoverad", "totalrenoverat", "newly renovated", "renovated", "updated")
KITCHEN = ("nytt kok", "nyrenoverat kok", "renoverat kok", "modernt kok", "modern kitchen", "new kitchen", "renovated kitchen")
BATH = ("nytt badrum", "nyrenoverat badrum", "renoverat badrum", "modernt badrum", "modern bathroom", "new bathroom", "renovated bathroom")
VIEW = ("utsikt", "sjoutsikt", "havsglimt", "vattenutsikt", "panoramavy", "view", "water view")
QUIET = ("lugnt lage", "lugnt omrade", "tyst lage", "stillsamt", "rofullt", "quiet", "calm area")
NEEDS = ("renoveringsbehov", "moderniseringsbehov", "renoveras", "originalskick", "fixer upper", "needs renovation", "in need of renovation")
LUXURY = ("exklusiv", "exklusivt", "pakostad", "premium", "luxe", "lyx", "sekelskifte", "takhojd", "kakelugn", "terrass", "balkong", "sjoutsikt", "water view")
MONTHS = ("jan", "feb", "mar", "apr", "maj", "jun", "jul", "aug", "sep", "okt", "nov", "dec")
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y", "ja", "1"), ("false", "f", "no", "n", "nej", "0")
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def normalize_ws(x: Column) -> Column:
    for s in (*NBSP_ESCAPED, *NBSP):
        x = F.replace(x, F.lit(s), F.lit(" "))
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def area_token(x: Column) -> Column:
    """The last part of `Type · Area · Municipality` that isn't generic; else the first, or the one before Stockholm."""
    parts = F.filter(F.split(normalize_ws(x), r"\s*·\s*"), lambda t: t != "")
    named = F.filter(parts, lambda t: ~F.lower(F.trim(t)).isin(*GENERIC))
    last = F.when((F.size(parts) >= 3) & (F.lower(F.element_at(parts, -1)) == "stockholm"), F.try_element_at(parts, F.lit(-2))).otherwise(F.try_element_at(parts, F.lit(1)))
    return F.when(x.contains("·"), F.coalesce(F.try_element_at(named, F.lit(-1)), last)).otherwise(normalize_ws(x))


def transliterate(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.translate(F.lower(x), "öäå", "oaa"), "[^a-zA-Z0-9_]", "_"), "_+", "_"), "^_|_$", "")


def area_slug(x: Column) -> Column:
    s = transliterate(area_token(x))
    return F.when(s.isNull() | (s == ""), "unknown").otherwise(s)


def clean_area(x: Column) -> Column:
    a = F.trim(F.regexp_replace(area_token(x), '^"+|"+$', ""))
    out = a
    for k, v in CONSOLIDATED.items():
        out = F.when(a == k, v).otherwise(out)
    for k, v in SPELLING.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    out = F.regexp_replace(out, r"^Söder(?=$| )", "Södermalm")
    slashed = F.lit(None).cast("string")
    for name in DISTRICTS:
        slashed = F.when(out.contains(name), name).otherwise(slashed)
    return F.when(out.contains("/"), F.coalesce(slashed, out)).otherwise(out)


def display_name(slug: Column, known: dict[str, str] | None = None) -> Column:
    """A slug's name from a dictionary, else its words with capitals."""
    out = F.initcap(F.replace(slug, F.lit("_"), F.lit(" ")))
    for k, v in (known or {}).items():
        out = F.when(slug == k, v).otherwise(out)
    return out


def street_ml(address: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(address), r"\s+", " ")), r"\s+\d+\w?(?:[-/]\d+\w?)?.*$", "")


def street_report(address: Column) -> Column:
    return F.regexp_replace(address, r"\s+\d+\s*[A-Za-z]?$", "")


def compound_key(*parts: Column) -> Column:
    """Parts joined by |, unless one is missing, blank or `unknown`."""
    ok = F.lit(True)
    for p in parts:
        ok = ok & p.isNotNull() & ~F.trim(p).isin("", "unknown")
    return F.when(ok, F.concat_ws("|", *parts))


def postal_code(x: Column) -> Column:
    code = F.regexp_replace(F.regexp_extract(x, r"\b(\d{3}\s?\d{2}|\d{5})\b", 1), r"\s", "")
    return F.when(code != "", code)


def geocode_key(address: Column, area: Column) -> Column:
    """The warehouse's key: four replacements only, unlike the slug."""
    low = F.lower(area)
    for a, b in ((" ", "_"), ("å", "a"), ("ä", "a"), ("ö", "o")):
        low = F.replace(low, F.lit(a), F.lit(b))
    return F.concat(address, F.lit(", "), low)


@F.arrow_udf(T.StringType())
def without_accents(x: pa.Array) -> pa.Array:
    """Lower case, compatibility forms taken apart (NFKD), combining marks left out; texts in ASCII only change case."""

    def plain(t):
        if t is None or t.isascii():
            return t and t.lower()
        return "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))

    return pa.array([plain(t) for t in x.to_pylist()], pa.string())


def plain_description(x: Column) -> Column:
    return F.trim(F.regexp_replace(without_accents(x), "[^a-z0-9]+", " "))


def any_phrase(x: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | x.contains(p)
    return F.when(x.isNotNull() & out, 1).otherwise(0)


def count_phrases(x: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for p in phrases:
        out = out + F.when(x.contains(p), 1).otherwise(0)
    return out


def description_features(description: Column) -> dict[str, Column]:
    """Length, words, phrase flags, and condition (0..5) and premium (0..8) scores."""
    t = F.coalesce(plain_description(description), F.lit(""))
    f = {
        "renovated": any_phrase(t, RENOVATED), "modern_kitchen": any_phrase(t, KITCHEN), "modern_bathroom": any_phrase(t, BATH),
        "has_view": any_phrase(t, VIEW), "quiet": any_phrase(t, QUIET), "needs_renovation": any_phrase(t, NEEDS), "luxury_count": count_phrases(t, LUXURY),
    }
    fit = f["renovated"] + f["modern_kitchen"] + f["modern_bathroom"] + 0.5 * f["quiet"] - 2 * f["needs_renovation"]
    rich = f["luxury_count"] + f["has_view"] + 0.5 * (f["modern_kitchen"] + f["modern_bathroom"] + f["quiet"])
    bounded = lambda x, most: F.greatest(F.lit(0.0), F.least(F.lit(most), x.cast("double")))
    words = F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))
    return {"length": F.length(t).cast("long"), "words": words.cast("long"), **f, "condition": bounded(fit, 5.0), "premium_text": bounded(rich, 8.0)}


def swedish_month(x: Column) -> Column:
    """`jan -22` as the first of that month."""
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.trim(x), 1, 3))).cast("int")
    year = F.regexp_extract(x, r"-\s*(\d{2})\s*$", 1)
    return F.when((month > 0) & (year != ""), F.make_date(F.lit(2000) + year.try_cast("int"), month, F.lit(1)))


def listing_id_of(url: Column, hosts: tuple[str, ...] = ()) -> Column:
    """The last number in a url's path or its `id` parameter; null at other hosts than the given ones and their subdomains, if any."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))
    if hosts:
        ok = F.lit(False)
        for h in hosts:
            ok = ok | (host == h) | host.endswith(f".{h}")
        url = F.when(ok, url)
    path = F.regexp_extract(url, r"/(\d+)/?(?:[?#].*)?$", 1)
    query = F.regexp_extract(url, r"[?&]id=(\d+)", 1)
    return F.when(path != "", path).when(query != "", query)


def to_bool(x: Column) -> Column:
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def to_float(x: Column) -> Column:
    """Spaces dropped, decimal comma read as a point; null if it isn't a number."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(?U)\s", ""), ",", ".").try_cast("double")


def to_int(x: Column) -> Column:
    """Truncated toward zero."""
    n = F.regexp_replace(x.cast("string"), r"(?U)\s", "").try_cast("double")
    return F.when(F.abs(n) < 9e18, n.cast("long"))
