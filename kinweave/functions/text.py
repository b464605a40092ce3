"""String expressions used by the cleaning steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the note some version-control exports put before a copied path.
COPIED_PREFIX = r"^  - copied, (changed|unchanged) from r\d*, "


def strip(col) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def free_text(col) -> Column:
    """Drop `#` and turn line breaks into sentence ends."""
    return F.regexp_replace(F.replace(col, F.lit("#"), F.lit("")), r"\r\n|\r|\n", ". ")


def raw_lines(col) -> Column:
    """Turn carriage returns and the `_nl_` mark into sentence ends."""
    return F.regexp_replace(col, r"\r|_nl_", ". ")


def project_name(col) -> Column:
    bare = F.regexp_replace(F.lower(col), r"\s*\([^()]*\)\s*", "")
    bare = F.regexp_replace(bare, r"[-:].*$", "")
    return F.replace(strip(F.replace(bare, F.lit("/"), F.lit("-"))), F.lit(" "), F.lit("-"))


def file_path(col) -> Column:
    """The pattern runs only on paths that begin like a copy note."""
    noted = F.startswith(col, F.lit("  - copied, "))
    return F.when(noted, F.regexp_replace(col, COPIED_PREFIX, "")).otherwise(col)


def sender_name(col) -> Column:
    bare = F.when(
        F.contains(col, F.lit("#")), strip(F.regexp_replace(col, r"^#+|#+$", ""))
    ).otherwise(col)
    return F.replace(bare, F.lit("\n"), F.lit(" "))


def extension(path) -> Column:
    """From the last dot of the whole path, lower-cased; empty without a dot."""
    tail = F.concat(F.lit("."), F.lower(F.substring_index(path, ".", -1)))
    return F.when(F.contains(path, F.lit(".")), tail).otherwise("")


def base_name(path) -> Column:
    return F.substring_index(path, "/", -1)


def person_key(name) -> Column:
    """The letters of a person's name: no mail domain, no bracketed notes, case kept."""
    bare = F.regexp_replace(F.split_part(name, F.lit("@"), F.lit(1)), r"[(\[].*?[)\]]", "")
    return F.trim(F.regexp_replace(bare, "[^a-zA-Z ]+", ""))


def capitalised(name) -> Column:
    """Every space-separated word with one capital."""
    return F.array_join(
        F.transform(
            F.split(name, " "),
            lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2)))),
        ),
        " ",
    )


def utc_text(ts) -> Column:
    """`2024-01-31 08:00:00+00:00`, with microseconds where there are any."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
        F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
        F.lit("+00:00"),
    )


def reference_tokens(col) -> Column:
    """Message ids named in a reply field, those broken over white space rejoined."""
    words = F.filter(F.split(col, r"[\n\t ]"), lambda w: w != "")
    has = lambda w, mark: F.contains(w, F.lit(mark))
    pairs = F.filter(
        F.zip_with(
            words,
            F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
            lambda a, b: F.when(
                has(a, "<") & ~has(a, ">") & ~has(b, "<") & has(b, ">"), F.concat(a, b)
            ),
        ),
        lambda w: w.isNotNull(),
    )
    whole = F.filter(words, lambda w: has(w, "<") & has(w, ">"))
    return F.concat(pairs, whole)
