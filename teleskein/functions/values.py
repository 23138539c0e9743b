"""Scalar decode rules: nanosecond times, any-values, numbers as text, attribute maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS_PER_SECOND = 1_000_000_000

# Text forms a number may take when it is sent as a string.
INTEGER_TEXT = r"^[+-]?[0-9]+$"
FLOAT_TEXT = r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable."""
    return F.transform(F.array(value), body)[0]


# --- time ---


def nano_instant(text: Column) -> Column:
    """Unix nanoseconds from integer text; NULL where they denote no time.

    Absent, zero and non-integer text mean "no time"; so does a negative value with a
    fraction of a second.
    """
    ns = F.when(text.rlike(INTEGER_TEXT), text.try_cast("bigint"))
    return F.when((ns > 0) | ((ns < 0) & (ns % NANOS_PER_SECOND == 0)), ns)


def instant_to_time(ns: Column) -> Column:
    """Nanoseconds to a zone-free UTC timestamp, truncated to microseconds."""
    return F.expr(_EPOCH) + F.expr("interval '0.000001' second") * int_div(ns, 1000)


def int_div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by))


def time_to_micros(time: Column) -> Column:
    """Zone-free timestamp to Unix microseconds, whatever the session time zone is."""
    seconds = (time - F.expr(_EPOCH)).cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("bigint")


def time_to_nanos(time: Column) -> Column:
    return time_to_micros(time) * 1000


def span_duration(start_ns: Column, end_ns: Column) -> Column:
    """End minus start in nanoseconds; 0 where either is missing or the result overflows."""
    return F.coalesce(F.try_subtract(end_ns, start_ns), F.lit(0).cast("bigint"))


# --- numbers as text ---


def _closest_text(number: Column) -> Column:
    """Text of a whole double from 1e16 on by the fewest of 15 to 17 digits that read back as
    the same number, and of those the closest. Exact in decimals, NULL from 1e37 on."""
    size, unit = F.abs(number), 2.0**61
    high = F.floor(size / F.lit(unit))
    low = (size - high.cast("double") * F.lit(unit)).try_cast("bigint").try_cast("decimal(19,0)")
    exact = high.try_cast("decimal(18,0)") * F.lit(2**61).cast("decimal(19,0)") + low

    def rounded(whole: Column, digits: int) -> Column:
        zeros = F.length(whole.cast("string")) - digits
        power = F.concat(F.lit("1"), F.repeat(F.lit("0"), zeros)).cast("decimal(38,0)")
        half = F.when(zeros > 0, F.concat(F.lit("5"), F.repeat(F.lit("0"), zeros - 1))).otherwise("0").cast("decimal(38,0)")
        return F.concat(int_div(whole + half, power).cast("string"), F.repeat(F.lit("0"), zeros))

    def choose(whole: Column) -> Column:
        chosen = rounded(whole, 17)
        for digits in (16, 15):
            text = rounded(whole, digits)
            chosen = F.when(text.try_cast("double") == size, text).otherwise(chosen)
        return F.concat(F.when(number < 0, "-").otherwise(""), chosen)

    return F.when((size >= 1e16) & (size < 1e37), let(exact.try_cast("decimal(38,0)"), choose))


def _digits_and_exponent(number: Column, body) -> Column:
    """Split a finite double into sign, significant digits and decimal exponent.

    The digits come from the JVM's text form. With 17 digits that form is sometimes one
    longer than needed, so the 16-digit rounding is used where it reads back as the same
    number.
    """

    def parts(text: Column) -> Column:
        mantissa = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), "^-", "")
        exponent = F.coalesce(F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int"), F.lit(0))
        whole = F.split_part(mantissa, F.lit("."), F.lit(1))
        fraction = F.split_part(mantissa, F.lit("."), F.lit(2))
        # Position of the point counted from the first significant digit.
        leading = F.length(F.regexp_extract(F.concat(whole, fraction), "^0*", 0))
        return F.struct(
            text.startswith("-").alias("negative"),
            F.regexp_replace(F.concat(whole, fraction), "^0+|0+$", "").alias("digits"),
            (F.length(whole) + exponent - leading).alias("point"),
        )

    def shorten(text: Column) -> Column:
        def candidate(p: Column) -> Column:
            rounded = F.round(
                F.concat_ws(".", F.substring(p["digits"], 1, 1), F.substring(p["digits"], 2, 20)).cast(
                    "decimal(18,16)"
                ),
                15,
            )
            return F.concat(
                F.when(p["negative"], "-").otherwise(""),
                rounded.cast("string"),
                F.lit("E"),
                (p["point"] - 1).cast("string"),
            )

        def choose(p: Column) -> Column:
            return let(
                candidate(p),
                lambda c: F.when(c.try_cast("double") == text.try_cast("double"), parts(c)).otherwise(p),
            )

        return let(parts(text), lambda p: F.when(F.length(p["digits"]) == 17, choose(p)).otherwise(p))

    text = F.coalesce(_closest_text(number), number.cast("string"))
    return let(text, lambda text: let(shorten(text), body))


def _plain(p: Column) -> Column:
    digits, point = p["digits"], p["point"]
    size = F.length(digits)
    return (
        F.when(digits == "", "0")
        .when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size)))
        .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
    )


def _sign(p: Column) -> Column:
    return F.when(p["negative"], "-").otherwise("")


def double_text(number: Column) -> Column:
    """Plain decimal text: no exponent and no trailing ``.0``."""

    def without_zero_fraction(text: Column) -> Column:
        return F.when(text.endswith(".0"), F.substr(text, F.lit(1), F.length(text) - 2)).otherwise(text)

    def as_decimal(scale: int) -> Column:
        digits = number.try_cast(f"decimal(38,{scale})").cast("string")
        return F.rtrim(F.rtrim(digits, F.lit("0")), F.lit("."))

    def text_of(text: Column) -> Column:
        mantissa, size = F.instr(text, "E") - 1, F.abs(number)
        return (
            # Up to 16 digits the JVM's text is as short as can be.
            F.when((mantissa < 0) & (F.length(text) <= 16), without_zero_fraction(text))
            .when(mantissa.between(1, 17) & (size >= 1e7) & (size < 1e16), as_decimal(17))
            .when(mantissa.between(1, 17) & size.between(1e-19, 1), as_decimal(37))
            .otherwise(_digits_and_exponent(number, lambda p: F.concat(_sign(p), _plain(p))))
        )

    return let(number.cast("string"), text_of)


def json_number_text(value: Column) -> Column:
    """Text of a non-integer JSON number held in a VARIANT.

    Whole numbers up to 2^64 print as integers; others as the shortest float text, with a
    point, and with an exponent below 1e-5 and from 1e16 on.
    """

    def text(p: Column) -> Column:
        digits, point = p["digits"], p["point"]
        scientific = F.concat(
            F.substring(digits, 1, 1),
            F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""),
            F.lit("e"),
            (point - 1).cast("string"),
        )
        plain = F.when((point >= F.length(digits)) | (digits == ""), F.concat(_plain(p), F.lit(".0"))).otherwise(
            _plain(p)
        )
        return F.concat(
            _sign(p), F.when((digits == "") | point.between(-4, 16), plain).otherwise(scientific)
        )

    wide = F.try_variant_get(value, "$", "decimal(38,0)")
    unsigned = (
        F.schema_of_variant(value).rlike(r"^DECIMAL\([0-9]+,0\)$")
        & (wide > F.lit("9223372036854775807").cast("decimal(38,0)"))
        & (wide <= F.lit("18446744073709551615").cast("decimal(38,0)"))
    )
    return F.when(unsigned, wide.cast("string")).otherwise(
        _digits_and_exponent(F.try_variant_get(value, "$", "double"), text)
    )


# --- values and attributes (on the typed parse) ---


def any_value_text(value: Column) -> Column:
    """Text of a value: string, else int, else bool, else double, else empty."""
    return F.coalesce(
        value["stringValue"],
        value["string_value"],
        value["intValue"],
        value["int_value"],
        value["boolValue"].cast("string"),
        value["bool_value"].cast("string"),
        double_text(value["doubleValue"]),
        double_text(value["double_value"]),
        F.lit(""),
    )


def service_name(attributes: Column) -> Column:
    """Text of the first ``service.name`` attribute that has a value, else ``unknown``."""
    named = F.filter(attributes, lambda a: (a["key"] == "service.name") & a["value"].isNotNull())
    texts = F.transform(F.slice(named, 1, 1), lambda a: any_value_text(a["value"]))
    return F.coalesce(F.try_element_at(texts, F.lit(1)), F.lit("unknown"))


def attribute_map(attributes: Column) -> Column:
    """Key/value list to a map of strings; the last of a repeated key wins, absent is empty."""
    entries = F.transform(
        attributes, lambda a: F.struct(a["key"].alias("key"), any_value_text(a["value"]).alias("value"))
    )
    last_of_key = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(attributes["key"], i + 2, F.size(attributes)), lambda k: k == e["key"]),
    )
    unique = F.size(F.array_distinct(attributes["key"])) == F.size(attributes)
    return F.when(attributes.isNull(), F.create_map().cast("map<string,string>")).otherwise(
        F.map_from_entries(F.when(unique, entries).otherwise(last_of_key))
    )


def point_value(as_double: Column, as_int: Column) -> Column:
    """A data point's number: the double, else the integer or numeric text, else 0."""
    parsed = F.when(as_int.rlike(FLOAT_TEXT), as_int.try_cast("double"))
    return F.coalesce(as_double, parsed, F.lit(0.0))
