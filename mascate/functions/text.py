"""Text formats and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two tax-id layouts and the blanks a login or password is stripped of.
MASK14 = (r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")
MASK11 = (r"^(\d{3})(\d{3})(\d{3})(\d{2})$", "$1.$2.$3-$4")
BLANKS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def mask_tax_id14(text: Column) -> Column:
    """``NN.NNN.NNN/NNNN-NN`` if the text has 14 digits, else the text unchanged."""
    pattern, layout = MASK14
    d = F.regexp_replace(text, r"\D", "")
    return F.when(d.rlike(pattern), F.regexp_replace(d, pattern, layout)).otherwise(text)


def mask_tax_id11(text: Column) -> Column:
    """``NNN.NNN.NNN-NN`` if the text is exactly 11 digits, else the text unchanged."""
    return F.regexp_replace(text, *MASK11)


def mask_tax_id(text: Column) -> Column:
    """The mask that fits the number of characters: 11 or 14; else the text unchanged."""
    return (
        F.when(F.length(text) == 11, mask_tax_id11(text))
        .when(F.length(text) == 14, mask_tax_id14(text))
        .otherwise(text)
    )


def title_case(text: Column, accented_words: bool = False) -> Column:
    """Lower case with each word's first letter raised.

    A word is a run of ASCII letters, digits and underscores, so an accented letter ends a word
    (``ÁGATA`` gives ``áGata``). With ``accented_words`` accented letters belong to words.
    """
    letters = r"\p{L}\p{M}\p{N}_" if accented_words else "a-z0-9_"
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"([{letters}]+|[^{letters}]+)"), F.lit(1))

    def raise_first(run: Column) -> Column:
        head = F.substring(run, 1, 1)
        if not accented_words:
            head = F.when(head.rlike("[a-z]"), F.upper(head)).otherwise(head)
        else:
            head = F.upper(head)
        return F.concat(head, F.substring(run, 2, 2147483647))

    return F.array_join(F.transform(runs, raise_first), "")


def strip_blanks(text: Column) -> Column:
    """Without blanks of any kind at both ends (``trim`` drops the space character only)."""
    return F.regexp_replace(text, f"^{BLANKS}|{BLANKS}$", "")


def login_key(login: Column) -> Column:
    """The stored form of a login: stripped and in upper case."""
    return F.upper(strip_blanks(login))


def password_digest(password: Column) -> Column:
    """The stored form of a password: MD5 of the stripped text, in hex."""
    return F.md5(strip_blanks(password))


def text_digest(text: Column) -> Column:
    """SHA-256 of a text, in hex."""
    return F.sha2(text, 256)


def date_text(day: Column) -> Column:
    """A date as ``dd/MM/yyyy``; NULL stays NULL."""
    return F.date_format(day, "dd/MM/yyyy")
