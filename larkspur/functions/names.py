"""Column functions over symbol names, signatures and types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Traits whose derived methods are noise, calls that are noise, wrappers looked into.
DERIVED_TRAITS = ("PartialEq", "Eq", "PartialOrd", "Ord", "Clone", "Debug", "Hash", "Default", "Serialize", "Deserialize")
NOISE_METHODS = (
    "clone", "to_string", "to_owned", "to_vec", "into", "unwrap", "expect", "unwrap_or", "unwrap_or_default", "unwrap_or_else",
    "map", "map_err", "and_then", "or_else", "ok", "err", "collect", "iter", "into_iter", "push", "pop", "len", "is_empty",
    "as_ref", "as_mut", "borrow", "deref", "fmt", "write", "read", "flush",
)
NOISE_CALLS = ("Ok", "Err", "Some", "None", "format", "println", "eprintln", "vec")
WRAPPERS = ("result", "option", "box", "arc", "rc", "vec", "Result", "Option", "Box", "Arc", "Rc", "Vec")
DERIVE_MARKS = ("::_serde::", "::_::_serde::", "as bincode::Encode>::encode", "as bincode::Decode<", "as bincode::BorrowDecode<", "as clap::")
MACRO_MARKS = ("::into_value", "::__build", "::Builder", "Builder::", "props::", "::Props::")


def last_segment(name: Column) -> Column:
    return F.substring_index(name, "::", -1)


def before_last_segment(name: Column) -> Column:
    """What stands before the last ``::``; null without one."""
    return F.when(name.contains("::"), F.regexp_extract(name, r"(?s)^(.*)::", 1))


def after_first_segment(name: Column) -> Column:
    """What stands after the first ``::``; null without one."""
    return F.when(name.contains("::"), F.regexp_extract(name, r"(?s)^.*?::(.*)$", 1))


def display_name(name: Column) -> Column:
    """``<T as Tr>::m`` is T::m by T's leaf, ``<T>`` its leaf, else the last segment."""
    inner = F.substring(name, 2, 1 << 30)
    owner = last_segment(F.substring_index(inner, " as ", 1))
    as_trait = F.when(inner.contains(">::"), F.concat(owner, F.lit("::"), F.regexp_extract(inner, r"(?s)^.*?>::(.*)$", 1))).otherwise(owner)
    bare = last_segment(F.regexp_replace(inner, ">+$", ""))
    return F.when(name.startswith("<") & inner.contains(" as "), as_trait).when(name.startswith("<"), bare).otherwise(last_segment(name))


def shown_name(display: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(display, F.lit("")), name)


def shorten_signature(signature: Column, most: int) -> Column:
    """Paths collapse to their last segment; longer results end in three dots."""
    short = F.regexp_replace(signature, r"(?:[A-Za-z0-9_]+::)+", "")
    return F.when(F.octet_length(short) > most, F.concat(F.substring(short, 1, max(most - 3, 0)), F.lit("..."))).otherwise(short)


def line_suffix(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))).otherwise("")


def strip_visibility(name: Column) -> Column:
    return F.regexp_replace(name, r"^(?:pub\([^)]*\) |pub )", "")


def strip_closure(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)::\{closure.*$", "")


def strip_crate_prefix(name: Column) -> Column:
    """Without its first segment, inside a leading ``<`` too."""
    return F.when(name.contains("::"), F.regexp_replace(name, r"^(<?)[^:]*::", "$1")).otherwise(name)


def strip_generics(name: Column) -> Column:
    """Without what angle brackets hold, however deep; an unclosed one drops the rest."""
    marks = F.regexp_extract_all(name, F.lit("([<>]|[^<>]+)"), F.lit(1))
    none = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(at: Column, part: Column) -> Column:
        depth = F.when(part == "<", at["depth"] + 1).when(part == ">", F.greatest(at["depth"] - 1, F.lit(0))).otherwise(at["depth"])
        out = F.when((at["depth"] == 0) & ~part.isin("<", ">"), F.concat(at["out"], part)).otherwise(at["out"])
        return F.struct(depth.alias("depth"), out.alias("out"))

    return F.when(name.contains("<") | name.contains(">"), F.aggregate(marks, none, step)["out"]).otherwise(name)


def _after_last_for(leaf: Column) -> Column:
    return F.substring_index(leaf, " for ", -1)


def owning_type(name: Column) -> Column:
    """Lower-case type that owns a method; null for a name of one segment."""
    prefix = before_last_segment(name)
    return F.lower(F.substring_index(_after_last_for(last_segment(prefix)), "<", 1))


def owner_leaf(name: Column) -> Column:
    return F.substring_index(_after_last_for(last_segment(F.lower(name))), "<", 1)


def leaf_type(ty: Column) -> Column:
    """The type behind a reference, lifetime, mut/dyn/impl and one wrapper."""
    bare = F.regexp_replace(ty, r"^&", "")
    bare = F.regexp_replace(bare, r"^'[^ ]* ", "")
    for word in ("mut ", "dyn ", "impl "):
        bare = F.regexp_replace(bare, f"^{word}", "")
    outer = F.trim(F.substring_index(bare, "<", 1))
    first = F.trim(F.substring_index(F.regexp_replace(F.regexp_extract(bare, r"(?s)^[^<]*<(.*)$", 1), ">+$", ""), ",", 1))
    first = F.regexp_replace(F.regexp_replace(first, "^&", ""), "^mut ", "")
    inner = F.trim(F.substring_index(first, "<", 1))
    return F.when(outer.isin(*WRAPPERS) & (inner != "") & (inner != outer), inner).otherwise(outer)


def is_derived_noise(name: Column) -> Column:
    """A method of a derived trait: ``<X as path::Leaf>``."""
    path = F.substring_index(F.get(F.split(name, "as "), F.lit(1)), ">", 1)
    return F.coalesce(name.startswith("<") & last_segment(path).isin(*DERIVED_TRAITS), F.lit(False))


def is_noise(call: Column) -> Column:
    """A call that says little about what a function does."""
    return call.startswith("self.") | F.substring_index(call, ".", -1).isin(*NOISE_METHODS) | call.isin(*NOISE_CALLS)


def is_derive_generated(name: Column) -> Column:
    out = F.lit(False)
    for mark in DERIVE_MARKS:
        out = out | name.contains(mark)
    return out


def is_test_fn(file: Column, name: Column) -> Column:
    """A test by an extractor's rule: its folder, its name or its module's."""
    return file.contains("/tests/") | file.contains("\\tests\\") | name.startswith("test_") | name.contains("::test_") | name.contains("::tests::")


def disambiguate(display: Column, name: Column, signature: Column) -> Column:
    """A display name of one segment with the type of the impl that the signature names, else by the full name."""
    inside = F.substring_index(F.regexp_extract(signature, r"(?s)^.*?impl (.*)$", 1), ">::", 1)
    named = signature.contains("impl ") & F.regexp_extract(signature, r"(?s)^.*?impl (.*)$", 1).contains(">::")
    owner = last_segment(F.substring_index(inside, " for ", -1))
    shown = shown_name(display, name)
    return F.when(shown.contains("::"), shown).when(named, F.concat(owner, F.lit("::"), shown)).when(name.contains("::"), display_name(name)).otherwise(shown)


def is_macro_name(name: Column) -> Column:
    out = name.endswith("::build")
    for mark in MACRO_MARKS:
        out = out | name.contains(mark)
    return out


def parameters(signature: Column) -> Column:
    """array<struct<name,type>> of a signature's parameters, receivers left out."""
    inside = F.regexp_extract(signature, r"(?s)^[^(]*\((.*)\)", 1)
    parts = F.filter(F.transform(F.split(inside, ","), lambda p: F.trim(p)), lambda p: (p != "") & ~p.isin("self", "&self", "&mut self", "mut self") & p.contains(":"))
    return F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("name"), F.trim(F.regexp_replace(p, r"(?s)^[^:]*:", "")).alias("type")))


def return_type(signature: Column) -> Column:
    """What follows the first arrow, without an opening brace; null without one."""
    after = F.regexp_extract(signature, r"(?s)^.*?->(.*)$", 1)
    return F.when(signature.contains("->"), F.trim(F.regexp_replace(F.trim(after), r"\{+$", "")))


def packed_calls(calls: Column) -> Column:
    """array<struct<name,line>> of ``name@line, ...``; a line that is no number is 0."""
    parts = F.filter(F.split(calls, ", "), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.when(p.contains("@"), F.regexp_extract(p, r"(?s)^(.*)@", 1)).otherwise(p).alias("name"),
            F.when(p.contains("@"), F.coalesce(F.regexp_extract(p, r"(?s)@([^@]*)$", 1).try_cast("int"), F.lit(0))).otherwise(0).alias("line"),
        ),
    )


def struct_fields(body: Column) -> Column:
    """array<struct<name,type>> of a struct's lines after the first: no comments, blanks or closing brace."""
    rows = F.transform(F.slice(F.split(body, "\n"), 2, 1 << 30), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    rows = F.filter(rows, lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("}") & x.contains(":"))
    rows = F.transform(rows, lambda x: F.regexp_replace(F.regexp_replace(x, r"^pub(\([^)]*\))? ", ""), ",$", ""))
    return F.transform(rows, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("type")))


def enum_variants(body: Column) -> Column:
    """Names of an enum's lines after the first, attributes left out too."""
    rows = F.transform(F.slice(F.split(body, "\n"), 2, 1 << 30), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    rows = F.filter(rows, lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("}") & ~x.startswith("#"))
    return F.filter(F.transform(rows, lambda x: F.regexp_replace(x, r"[({ ,].*$", "")), lambda x: x != "")


def field_pairs(accesses: Column) -> Column:
    """array<struct<receiver,field>> of ``Type.field, ...``, split at the first dot."""
    parts = F.filter(F.split(accesses, ", "), lambda p: p.contains("."))
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, ".", 1).alias("receiver"), F.regexp_replace(p, r"^[^.]*\.", "").alias("field")))


def generic_bounds(signature: Column) -> Column:
    """array<struct<param,bound>>, lower case: first bounds in ``<...>`` and after where."""
    lower = F.lower(signature)
    head = F.regexp_extract(lower, r"^[^(]*?<([^()]*)>\s*\(", 1)
    tail = F.regexp_replace(F.regexp_extract(lower, r"(?s)\bwhere\b(.*)$", 1), r"\{.*$", "")
    # commas inside brackets are no separators: what brackets hold is dropped first
    parts = F.filter(F.concat(F.split(strip_generics(head), ","), F.split(strip_generics(tail), ",")), lambda p: p.contains(":"))
    return F.filter(
        F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("param"), last_segment(F.trim(F.substring_index(F.regexp_replace(p, r"^[^:]*:(?!:)", ""), "+", 1))).alias("bound"))),
        lambda b: b["bound"] != "",
    )
