"""Field normalisers as column expressions.

Each normaliser is a pair: `<field>(c)` gives the normalised value, null where the input is
refused, and `<field>_error(c)` gives the refusal message, null where it is accepted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import blank, collapse, strip
from tallyframe.schema import AMOUNT

# Accepted formats.
PAN_FORMAT = r"^[A-Z]{5}[0-9]{4}[A-Z]$"
MOBILE_FORMAT = r"(?U)^\d{10}$"
ONE_REPEATED_DIGIT = r"^(\d)\1{9}$"
PLACEHOLDER_MOBILES = ("1234567890", "0123456789")

# Words removed from names, one after the other in this order.
NAME_NOISE = (
    r"\bJOINT\s+HOLDER(?!\w)",
    r"\bJOINT(?!\w)",
    r"\bJT\.?\s+HOLDER(?!\w)",
    r"\bJT\.?(?!\w)",
    r"\bMR\.?\b",
    r"\bMRS\.?\b",
    r"\bMS\.?\b",
    r"\bDR\.?\b",
    r"\bLATE\b",
    r"\bM/S\.?\b",
    r"\bHUF\b",
)

# Dot-atom local part of at most 64 characters, host labels without edge hyphens, a top label
# that is not numeric, and none of the reserved top-level names.
EMAIL_FORMAT = (
    r"(?Ui)^(?=.{1,254}$)(?=[^@]{1,64}@)"
    r"[\w!#$%&'*+/=?^`{|}~-]+(?:\.[\w!#$%&'*+/=?^`{|}~-]+)*@"
    r"(?!(?:[^@]*\.)?(?:arpa|invalid|local|localhost|onion|test)$)"
    r"(?:[\p{L}\p{M}\p{N}](?:[\p{L}\p{M}\p{N}-]{0,61}[\p{L}\p{M}\p{N}])?\.)+"
    r"(?!\d+$)[\p{L}\p{M}\p{N}](?:[\p{L}\p{M}\p{N}-]{0,61}[\p{L}\p{M}\p{N}])?$"
)


def _pan_text(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"(?U)[\s\-/]", ""))


def pan(c: Column) -> Column:
    text = _pan_text(c)
    return F.when(text.rlike(PAN_FORMAT), text)


def pan_error(c: Column) -> Column:
    text = _pan_text(c)
    return (
        F.when(c.isNull() | (c == ""), F.lit("PAN cannot be empty"))
        .when(~text.rlike(PAN_FORMAT),
              F.concat(F.lit("Invalid PAN format: '"), c, F.lit("' (normalized: '"), text, F.lit("')")))
    )


def name(c: Column) -> Column:
    out = strip(F.upper(F.coalesce(c, F.lit(""))))
    for pattern in NAME_NOISE:
        out = F.regexp_replace(out, "(?U)" + pattern, "")
    return collapse(F.translate(out, ",-/.", "    "))


def _digits(c: Column) -> Column:
    digits = F.regexp_replace(c, r"(?U)\D", "")
    over = F.length(digits) > 10
    return (
        F.when(over & digits.startswith("91"), F.substring(digits, 3, 1 << 30))
        .when(over & digits.startswith("0"), F.substring(digits, 2, 1 << 30))
        .otherwise(digits)
    )


def valid_mobile(c: Column) -> Column:
    return c.rlike(MOBILE_FORMAT) & ~c.rlike(ONE_REPEATED_DIGIT) & ~c.isin(*PLACEHOLDER_MOBILES)


def mobile(c: Column) -> Column:
    digits = _digits(c)
    return F.when(valid_mobile(digits), digits)


def mobile_error(c: Column) -> Column:
    """Null input is accepted: a record without a mobile number is fine."""
    digits = _digits(c)
    return (
        F.when(c == "", F.lit("Mobile number cannot be empty"))
        .when(F.length(digits) != 10,
              F.concat(F.lit("Mobile number must normalize to exactly 10 digits: '"), c,
                       F.lit("' (normalized: '"), digits, F.lit("')")))
        .when(digits.rlike(ONE_REPEATED_DIGIT),
              F.concat(F.lit("Mobile number is an obvious repeating dummy: '"), c, F.lit("'")))
        .when(digits.isin(*PLACEHOLDER_MOBILES),
              F.concat(F.lit("Mobile number is a placeholder dummy: '"), c, F.lit("'")))
    )


def valid_email(c: Column) -> Column:
    return strip(c).rlike(EMAIL_FORMAT)


def email(c: Column) -> Column:
    text = F.lower(strip(c))
    return F.when(text.rlike(EMAIL_FORMAT), text)


def email_error(c: Column) -> Column:
    return (
        F.when(c == "", F.lit("Email cannot be empty"))
        .when(~F.lower(strip(c)).rlike(EMAIL_FORMAT),
              F.concat(F.lit("Invalid email format: '"), c, F.lit("'")))
    )


# Layouts of written dates, as a shape and a pattern; month names in any case.
_DATE_LAYOUTS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2}-[A-Za-z]{4,9}-\d{4}$", "d-MMMM-yyyy"),
    (r"^[A-Za-z]{3}\s+\d{1,2},\s+\d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2}\s+[A-Za-z]{3}\s+\d{4}$", "d MMM yyyy"),
)
_SERIAL = r"^\d+(\.\d+)?$"


def date(c: Column) -> Column:
    """Written dates in eight layouts and spreadsheet serial numbers 1..100000.

    Spreadsheets count a 29 February 1900 that never was, so serials from 60 on are one day off.
    """
    text = strip(c.cast("string"))
    value = F.when(text.rlike(_SERIAL), text.try_cast("double"))
    days = F.when(value.between(1, 100000), F.floor(value).cast("int"))
    serial = F.when(days < 60, F.date_add(F.lit("1899-12-31").cast("date"), days)).otherwise(
        F.date_add(F.lit("1899-12-30").cast("date"), days)
    )
    written = F
    for shape, pattern in _DATE_LAYOUTS:
        value = collapse(text) if " " in pattern else text
        written = written.when(text.rlike(shape), F.try_to_timestamp(value, F.lit(pattern)))
    return F.coalesce(serial, F.to_date(written))


def date_error(c: Column) -> Column:
    text = c.cast("string")
    return (
        F.when(c.isNull(), F.lit("Date value cannot be None"))
        .when(blank(text), F.lit("Date value cannot be empty"))
        .when(date(c).isNull(), F.concat(F.lit("Unable to parse date: '"), text, F.lit("'")))
    )


def _amount_text(c: Column) -> Column:
    return strip(F.regexp_replace(c.cast("string"), ",", ""))


def amount(c: Column) -> Column:
    """Exact decimal; null and blank are zero, anything unreadable is null."""
    text = _amount_text(c)
    return F.when(text.isNull() | (text == ""), F.lit(0).cast(AMOUNT)).otherwise(text.try_cast(AMOUNT))


def amount_error(c: Column) -> Column:
    return F.when(amount(c).isNull(), F.concat(F.lit("Invalid amount format: '"), c.cast("string"), F.lit("'")))
