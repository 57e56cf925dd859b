"""Text, code and number normalisers as column expressions. They look alike and differ on purpose; none calls for Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# fixed values: accented Latin letters and their base letters
ACCENTED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįłñńňòóôõöøōőřśšťùúûüūůűýÿźżžÀÁÂÃÄÅĀĂĄÇĆČĎÈÉÊËĒĖĘĚÌÍÎÏĪĮŁÑŃŇÒÓÔÕÖØŌŐŘŚŠŤÙÚÛÜŪŮŰÝŸŹŻŽ"
PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiilnnnoooooooorsstuuuuuuuyyzzzAAAAAAAAACCCDEEEEEEEEIIIIIILNNNOOOOOOOORSSTUUUUUUUYYZZZ"

# fixed values: words that say nothing about a company, and address abbreviations
STOP_WORDS = ["SARL", "SAS", "SASU", "EURL", "STE", "SOCIETE", "ETS", "ETABLISSEMENTS", "AGENCE", "SERVICE", "DEPOT", "FRANCE", "RUE", "AVENUE"]
ABBREVIATIONS = {"AV": "AVENUE", "AVE": "AVENUE", "BD": "BOULEVARD", "BLD": "BOULEVARD", "CHE": "CHEMIN", "IMP": "IMPASSE", "PL": "PLACE", "RTE": "ROUTE", "ST": "SAINT", "STE": "SAINTE", "ZA": "ZONE ARTISANALE"}
STREET_TYPES = {"all": "allee", "av": "avenue", "ave": "avenue", "bd": "boulevard", "bld": "boulevard", "ch": "chemin", "che": "chemin", "imp": "impasse", "pl": "place", "r": "rue", "rte": "route", "sq": "square"}
FREIGHT_PREFIXES = ["PORT", "FRAIS", "TRANSPORT", "ECOTAXE", "DEEE"]


def fold_text(x: Column) -> Column:
    """Lower case without accents (Latin letters). Text of as many bytes as characters has none to look for."""
    return F.lower(F.when(F.octet_length(x) == F.length(x), x).otherwise(F.translate(x, ACCENTED, PLAIN)))


def compact_text(x: Column) -> Column:
    """White space of any kind (as Unicode has it, written out) is one blank."""
    return F.trim(F.regexp_replace(x, r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))


def address_compare(x: Column) -> Column:
    """Folded, everything but letters and digits one blank."""
    return F.trim(F.regexp_replace(fold_text(x), "[^a-z0-9]+", " "))


def name_key(x: Column) -> Column:
    return F.upper(address_compare(x))


def alnum_key(x: Column) -> Column:
    return F.regexp_replace(name_key(x), " ", "")


def vat_key(x: Column, keep: str = "A-Z0-9") -> Column:
    return F.regexp_replace(F.upper(x), f"[^{keep}]", "")


def postal_padded(x: Column) -> Column:
    """Up to five digits filled up with zeros from the left; anything else as it is, trimmed."""
    return F.when(F.trim(x).rlike("^[0-9]{1,5}$"), F.lpad(F.trim(x), 5, "0")).otherwise(F.trim(x))


def postal_digits(x: Column) -> Column:
    return F.left(F.regexp_replace(x, "[^0-9]+", ""), F.lit(5))


def postal_alnum(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", ""))


def order_key(x: Column) -> Column:
    return F.upper(F.regexp_replace(x, r"\s+", ""))


def matcher_text(x: Column) -> Column:
    """Folded; other characters than a-z, 0-9 and blanks become one blank each, then blanks are collapsed: the same as address_compare()."""
    return address_compare(x)


def scoring_text(x: Column) -> Column:
    """Upper case, quotes and dashes to blanks, abbreviations written out word by word."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.upper(fold_text(x)), "['’‘\"«»–—-]", " "), r"\s+", " ")), " ")
    table = F.create_map(*(F.lit(v) for pair in ABBREVIATIONS.items() for v in pair))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def city_key(x: Column) -> Column:
    """Folded, cut at cedex."""
    return F.trim(F.regexp_replace(address_compare(x), r"\b(cedex|cx)\b.*$", ""))


def street_key(x: Column) -> Column:
    """Folded with the abbreviated street types written out, the longest first."""
    short = sorted(STREET_TYPES, key=lambda s: (-len(s), s))

    def written_out(key: Column) -> Column:
        out = key
        for s in short:
            out = F.regexp_replace(out, rf"\b{s}\b", STREET_TYPES[s])
        return F.when(key.rlike(rf"\b(?:{'|'.join(short)})\b"), out).otherwise(key)

    return once(address_compare(x), written_out)


def tokens(x: Column) -> Column:
    """Distinct words of matcher_text()."""
    return F.array_distinct(F.array_remove(F.split(matcher_text(x), " "), ""))


def significant_tokens(x: Column) -> Column:
    """Words of three letters or digits and more, no stop words; repeats stay."""
    return F.filter(F.regexp_extract_all(F.upper(fold_text(x)), F.lit("[A-Z0-9]{3,}"), F.lit(0)), lambda w: ~w.isin(STOP_WORDS))


def token_jaccard(a: Column, b: Column) -> Column:
    """100 * common words / all words of two token arrays; 0 if either is empty."""
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(100.0 * F.size(F.array_intersect(a, b)) / either)


def article_code(x: Column) -> Column:
    """Upper case without the prefix EL or ELM, blanks and hyphens; null if it is a freight line or not 1 to 13 letters and digits."""
    raw = F.upper(F.trim(x))
    code = F.regexp_replace(F.regexp_replace(raw, "^EL[M]?", ""), r"[\s-]", "")
    freight = raw.rlike("^(" + "|".join(FREIGHT_PREFIXES) + ")")
    return F.when(~freight & code.rlike("^[A-Z0-9]{1,13}$"), code)


def edifact_safe(x: Column, length: int = 35) -> Column:
    """Separators and release signs to blanks, cut."""
    return F.left(F.trim(F.regexp_replace(x, r"[+:'?\r\n]", " ")), F.lit(length))


def edifact_escape(x: Column) -> Column:
    """Separators released with a question mark."""
    return F.regexp_replace(x, r"([?+:'])", r"\?$1")


def order_shape(x: Column) -> Column:
    """Letters to A and digits to 9, each run once with its length, like A3-94."""
    classes = F.regexp_replace(F.regexp_replace(F.upper(x), "[A-Z]", "A"), "[0-9]", "9")
    runs = F.regexp_extract_all(classes, F.lit("A+|9+|[^A9]"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[A9]"), F.concat(F.left(r, F.lit(1)), F.length(r).cast("string"))).otherwise(r)), "")


def doubled_share(x: Column) -> Column:
    """Share of letters that the next one repeats."""
    return F.when(F.length(x) > 0, F.regexp_count(x, F.lit(r"([A-Za-z])(?=\1)")) / F.length(x)).otherwise(0.0)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank nor a lone hyphen."""
    return F.coalesce(*(F.when(~F.trim(c).isin("", "-"), c) for c in columns))


# numbers and dates


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), for which the value is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def lenient_double(x: Column) -> Column:
    """French or English decimals with blanks and currency signs; null if there is no number."""
    text = F.regexp_replace(x, r"[^0-9,.\-]", "")
    last = F.greatest(F.instr(F.reverse(text), ","), F.lit(0)), F.greatest(F.instr(F.reverse(text), "."), F.lit(0))
    comma_decides = (last[0] > 0) & ((last[1] == 0) | (last[0] < last[1]))
    plain = F.when(comma_decides, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(text, F.lit(","), F.lit("")))
    return plain.try_cast("double")


def format_decimal(x: Column, scale: int = 6) -> Column:
    """Positive decimals rounded half up, trailing zeros gone; null otherwise."""
    number = F.replace(F.regexp_replace(x, r"\s", ""), F.lit(","), F.lit(".")).try_cast(f"decimal(38,{scale + 6})")
    rounded = F.round(number, scale).cast(f"decimal(38,{scale})").cast("string")
    return F.when(number > 0, F.regexp_replace(F.regexp_replace(rounded, "0+$", ""), r"\.$", ""))


def compact_date(x: Column) -> Column:
    """YYYYMMDD of dd/MM/yyyy, ISO dates, and eight digits (year first, else day first); null if it is no date."""
    t = F.trim(x)
    iso = F.try_to_timestamp(F.left(t, F.lit(10)), F.lit("yyyy-MM-dd"))
    french = F.try_to_timestamp(F.left(t, F.lit(10)), F.lit("dd/MM/yyyy"))
    year_first, day_first = F.try_to_timestamp(t, F.lit("yyyyMMdd")), F.try_to_timestamp(t, F.lit("ddMMyyyy"))
    eight = F.when(t.rlike("^[0-9]{8}$"), F.coalesce(F.when(F.left(t, F.lit(4)).between("1900", "2100"), year_first), day_first))
    return F.date_format(F.when(t.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}"), french).when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), iso).otherwise(eight), "yyyyMMdd")


def loose_date(x: Column) -> Column:
    """Eight digits of a date in other forms, without a look at the calendar: year first, or day first with parts of one or two digits and a year of two (20yy) or four; '' if it is none of these."""
    t = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^0-9/.\s-]", ""))
    two = lambda c: F.lpad(c, 2, "0")
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    year_first, day_first, short = r"^(\d{4})[/.\s-](\d{1,2})[/.\s-](\d{1,2})$", r"^(\d{1,2})[/.\s-](\d{1,2})[/.\s-](\d{4})$", r"^(\d{1,2})[/.\s-](\d{1,2})[/.\s-](\d{2})$"
    return (
        F.when(t.rlike(r"^\d{8}$"), t).when(t.rlike(year_first), F.concat(part(year_first, 1), two(part(year_first, 2)), two(part(year_first, 3))))
        .when(t.rlike(day_first), F.concat(part(day_first, 3), two(part(day_first, 2)), two(part(day_first, 1))))
        .when(t.rlike(short), F.concat(F.lit("20"), part(short, 3), two(part(short, 2)), two(part(short, 1)))).otherwise("")
    )


def utc_time(x: Column) -> Column:
    """ISO 8601 texts as timestamps; without an offset they are UTC. Null if they are none. The session's time zone must be UTC."""
    return F.when(F.trim(x).rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.replace(F.trim(x), F.lit(","), F.lit(".")).try_cast("timestamp"))


def department(postal: Column) -> Column:
    """The first two digits, NA with fewer."""
    digits = F.regexp_replace(F.coalesce(postal, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) >= 2, F.left(digits, F.lit(2))).otherwise("NA")


def control_reference(order_number: Column, at: Column) -> Column:
    """The last nine letters and digits and the time, fourteen characters at most."""
    return F.left(F.concat(F.right(F.regexp_replace(F.upper(order_number), "[^A-Z0-9]", ""), F.lit(9)), F.date_format(at, "HHmm")), F.lit(14))


def message_file(soldto: Column, order_number: Column, at: Column) -> Column:
    bare = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    return F.concat(F.lit("ORDERS_"), bare(soldto), F.lit("_"), bare(order_number), F.lit("_"), F.date_format(at, "yyyyMMddHHmmss"), F.lit(".tst"))


def actor(x: Column) -> Column:
    """Who did something, in lower case: an address as it is, the end of a path, what follows user: or users:."""
    v = F.lower(F.trim(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), "^[\"']+|[\"']+$", "")))
    tail = F.trim(F.element_at(F.split(F.translate(v, "\\", "/"), "/"), -1))
    return F.when(F.contains(v, F.lit("@")), v).when(F.contains(v, F.lit("/")), tail).when(v.rlike("^users?:"), F.trim(F.regexp_replace(v, "^users?:", ""))).otherwise(v)


def siren_vat(siren: Column, number: Column | None = None) -> Column:
    """French VAT number of nine SIREN digits (blanks allowed), null otherwise. number: the whole number that the key is of, where siren is only its first digits."""
    digits = F.regexp_replace(siren, r"\s", "")
    key = (12 + 3 * ((digits.try_cast("long") if number is None else number) % 97)) % 97
    return F.when(digits.rlike("^[0-9]{9}$"), F.concat(F.lit("FR"), F.lpad(key.cast("string"), 2, "0"), digits))


def luhn_valid(x: Column) -> Column:
    """Checksum of the digits; false without any."""
    digits = F.reverse(F.regexp_replace(x, "[^0-9]", ""))
    each = F.transform(F.filter(F.split(digits, ""), lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return (F.length(digits) > 0) & (F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0)
