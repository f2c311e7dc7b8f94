"""Text expressions.

Java's ``String.trim`` strips every character up to U+0020 and
``isBlank`` tests ``Character.isWhitespace``; the patterns below state both
character sets so the engines that check us agree.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of Java's trim() and Character.isWhitespace().
TRIM_CHARS = r"\x00-\x20"
WHITESPACE_CHARS = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}"
    r"\x{2028}\x{2029}\x{205F}\x{3000}"
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def java_trim(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), f"^[{TRIM_CHARS}]+|[{TRIM_CHARS}]+$", "")


def is_blank(col: Column | str) -> Column:
    """NULL, empty or only whitespace."""
    c = _c(col)
    return c.isNull() | c.rlike(f"^[{WHITESPACE_CHARS}]*$")


def after_last_slash(col: Column | str) -> Column:
    """Text after the last slash of the trimmed value.

    A per-value helper may reject blank input; as a column function a blank
    value simply yields ``''`` and NULL stays NULL, so one row cannot fail a job.
    """
    return F.regexp_replace(java_trim(col), ".*/", "")


#: Parts of a template: an escaped slot start, a slot up to its first closing brace, other text, a lone dollar.
_PART = r"\$\$\{|\$\{[^}]*\}|[^$]+|\$"
_DEFAULT = ":-"


def _parts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({_PART})"), F.lit(1))


def _slot_name(part: Column) -> Column:
    """Name of a slot part, without a default."""
    return F.split_part(F.substring(part, F.lit(3), F.length(part) - 3), F.lit(_DEFAULT), F.lit(1))


def _is_slot(part: Column) -> Column:
    return part.startswith("${") & part.endswith("}")


def _filled(text: Column, values: Column) -> Column:
    """``text`` with its slots taken from a map; what is inserted is not looked at again."""

    def one(part: Column) -> Column:
        inner = F.substring(part, F.lit(3), F.length(part) - 3)
        at = F.locate(_DEFAULT, inner)
        default = F.when(at > 0, F.substring(inner, at + len(_DEFAULT), F.length(inner)))
        slot = F.coalesce(F.try_element_at(values, _slot_name(part)), default, part)
        return F.when(part == "$${", F.lit("${")).when(_is_slot(part), slot).otherwise(part)

    return F.when(text.isNotNull(), F.array_join(F.transform(_parts(text), one), ""))


def _slots(text: Column, values: Column) -> Column:
    """Names of the slots of ``text`` that have a value."""
    names = F.transform(F.filter(_parts(F.coalesce(text, F.lit(""))), _is_slot), _slot_name)
    return F.array_distinct(F.filter(names, lambda n: F.try_element_at(values, n).isNotNull()))


def _resolved(text: Column, values: Column, count: int) -> Column:
    """``text`` filled from values that may hold slots themselves; a slot that leads back to itself is an error.

    The slots of each value make a graph of ``count`` names.  Its closure (paths
    double every round) tells whether a name that ``text`` reaches lies on a
    cycle.  Without one, values are filled from the values of the round before:
    after as many rounds as there are names the deepest one is whole.
    """
    closure_rounds = F.sequence(F.lit(1), F.lit(max(1, count.bit_length())))
    direct = F.transform_values(values, lambda _, v: _slots(v, values))

    def reach_on(reach: Column, names: Column) -> Column:
        return F.array_union(names, F.flatten(F.transform(names, lambda n: F.try_element_at(reach, n))))

    closure = F.aggregate(closure_rounds, direct, lambda reach, _: F.transform_values(reach, lambda _, names: reach_on(reach, names)))

    def checked(reach: Column) -> Column:
        looped = F.filter(reach_on(reach, _slots(text, values)), lambda n: F.array_contains(F.try_element_at(reach, n), n))
        message = F.concat(F.lit("template values refer to each other in a circle: "), F.array_join(F.array_sort(looped), ", "))
        whole = F.aggregate(F.sequence(F.lit(1), F.lit(count)), values, lambda m, _: F.transform_values(values, lambda _, v: _filled(v, m)))
        return F.when(F.size(looped) > 0, F.raise_error(message).cast("string")).otherwise(
            F.element_at(F.transform(F.array(whole), lambda m: _filled(text, m)), 1)
        )

    return F.element_at(F.transform(F.array(closure), checked), 1)


_SLOT = re.compile(r"\$\$\{|\$\{([^}]*)\}")


def _fixed(template: str, given: Mapping[str, Column]) -> Column:
    """A fixed template whose values hold no slots: one concat of its parts."""
    parts, at = [], 0
    for m in _SLOT.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m.group(1) is None:
            parts.append(F.lit("${"))
            continue
        name, mark, default = m.group(1).partition(_DEFAULT)
        other = F.lit(default if mark else m.group(0))
        parts.append(F.coalesce(given[name], other) if name in given else other)
    return F.concat(*parts, F.lit(template[at:]))


def fill_template(template: Column | str, values: Mapping[str, Column | str]) -> Column:
    """Fill ``${name}`` slots from columns (I19), also those that the values themselves hold.

    ``${name:-default}`` gives the default where the name is unknown or its value
    NULL; without a default such a slot stays as it is.  ``$${name}`` is an
    escape and comes out as the literal ``${name}``, in values as well.  A value
    whose slots lead back to it fails the row with an error that names the
    circle.  The order of ``values`` does not matter.  NULL templates give NULL.

    Rows whose values hold no ``${`` take a plain concat (fixed template) or one
    pass over the parts (template column); only the others resolve the graph.
    """
    given = {n: (v if isinstance(v, Column) else F.col(v)).cast("string") for n, v in values.items()}
    text = F.lit(template) if isinstance(template, str) else template
    if not given:
        return _fixed(template, {}) if isinstance(template, str) else _filled(text, F.lit(None).cast("map<string,string>"))
    table = F.create_map(*[c for n, v in given.items() for c in (F.lit(n), v)])
    plain = _fixed(template, given) if isinstance(template, str) else _filled(text, table)
    nested = F.concat_ws("", *given.values()).contains("${")
    return F.when(nested, _resolved(text, table, len(given))).otherwise(plain)


def pairs_to_mapping(*pairs: str) -> dict[str, str]:
    """``name1, value1, name2, value2`` -> mapping; an odd count is an error."""
    if not pairs:
        raise ValueError("vars is required")
    if len(pairs) % 2:
        raise ValueError("vars must have an even number of elements")
    return dict(zip(pairs[0::2], pairs[1::2]))


def bracket_wrap(col: Column | str) -> Column:
    """``(value)`` after trimming (I20); a blank value gives ``()`` rather than an error."""
    return F.concat(F.lit("("), java_trim(col), F.lit(")"))


def prepend_if_not_blank(col: Column | str, prefix: str) -> Column:
    """``prefix + trim(value)`` unless blank, else empty (I21); NULL counts as blank."""
    return F.when(is_blank(col), F.lit("")).otherwise(F.concat(F.lit(prefix), java_trim(col)))


def dash_to_underscore(col: Column | str) -> Column:
    """``2024-11`` -> ``2024_11`` for target names."""
    return F.replace(_c(col), F.lit("-"), F.lit("_"))


def fold_lines(col: Column | str) -> Column:
    """One line from a multi-line text.

    Every run of tab / CR / LF becomes one blank, unless a blank already
    stands right before it, in which case the run disappears.
    """
    return F.regexp_replace(_c(col), " ?[\\t\\r\\n]+", " ")


# Fixed value: the reason layout of a job problem.  ``problem_reason`` builds
# the same text with one concat (tests check it against this template).
REASON_TEMPLATE = "code: ${code}, title: ${title}, message: ${message}, cause: ${cause}, args: ${args}"


# Fixed value: how a NULL element of the argument list is shown.
NULL_ELEMENT = "<null>"


def array_text(values: Column) -> Column:
    """``{a,b}`` for a non-empty array (a NULL element shows as ``<null>``),
    ``''`` for NULL or empty."""
    return F.when(
        values.isNull() | (F.size(values) == 0), F.lit("")
    ).otherwise(F.concat(F.lit("{"), F.array_join(values, ",", NULL_ELEMENT), F.lit("}")))


def problem_reason(
    code: Column | str,
    title: Column | str,
    message: Column | str,
    cause: Column | str,
    args: Column | str,
) -> Column:
    """Reason text from five fields; NULL cause or empty args show as '' (I24)."""
    return F.concat(
        F.lit("code: "), _c(code),
        F.lit(", title: "), _c(title),
        F.lit(", message: "), _c(message),
        F.lit(", cause: "), F.coalesce(_c(cause), F.lit("")),
        F.lit(", args: "), array_text(_c(args)),
    )


def _mark(i: int) -> str:
    """Stands for a slot until its value goes in; made of control characters, which message texts do not hold."""
    return f"\u0000{i}\u0001"


def fill_positional(template: Column | str, args: Sequence[Column | str]) -> Column:
    """Fill ``{0}``, ``{1}``... from columns (message-table formatting, D11)."""
    out = _c(template)
    for i in range(len(args)):
        out = F.replace(out, F.lit("{" + str(i) + "}"), F.lit(_mark(i)))
    for i, arg in enumerate(args):
        out = F.replace(out, F.lit(_mark(i)), F.coalesce(_c(arg).cast("string"), F.lit("null")))
    return out
