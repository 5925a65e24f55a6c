"""Scalar functions of the literature model as SQL expressions: d is a dialect, x an expression."""

# ASCII white space; DOI prefixes and trailing marks; stop words and suffixes of the stemmer; suffixes of
# the canonicaliser; target words that a relaxed query keeps; English key words of the technical routes.
BLANKS = "[ \\t\\n\\r\\x0b\\x0c]"
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/")
DOI_TAIL = ".,;:)]}"
STOP = (
    "the", "a", "an", "and", "or", "of", "in", "on", "for", "with", "by", "to", "at", "from", "as", "is", "are", "was", "were", "be", "been",
    "using", "based", "via", "under", "over", "into", "between", "among", "effect", "effects", "study", "studies", "their", "its", "this", "that",
    "these", "those", "new", "novel", "high", "low",
)
STEMS = ("s", "es", "ing", "ed", "tion", "ers", "ies")
CANONICAL = ("polymerization", "chemistry", "addition", "reaction")
ANCHORS = ("shrinkage", "shrinkage stress", "contraction", "polymerization shrinkage", "stress")
ROUTE_KEYWORDS = {
    "Silorane/阳离子开环": ("silorane", "oxirane", "ring opening", "ring-opening", "cationic"),
    "Spiro-orthocarbonate 膨胀单体": ("spiro", "orthocarbonate", "expanding monomer", "soc"),
    "Thiol-ene 步增长延迟凝胶": ("thiol", "ene", "step growth", "step-growth"),
    "AFCT 网络重排": ("afct", "fragmentation", "chain transfer", "stress relax", "addition-fragmentation"),
    "无机填料高填充": ("filler", "silica", "particle", "packing", "inorganic", "nanofiller"),
    "理论基准": ("shrinkage stress", "polymerization shrinkage"),
}


#: DuckDB's list of the words of a title: what ASCII marks and blanks leave.
DUCK_WORDS = "list_distinct(regexp_extract_all(lower({}), '[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+'))"


def strip(d, x):
    return d.ra(x, f"^{BLANKS}+|{BLANKS}+$", "")


def normalize_doi(d, x):
    """Strip, lower, drop URL prefixes and trailing marks; null is empty."""
    x = f"lower({strip(d, f'coalesce({x}, {chr(39)}{chr(39)})')})"
    for p in DOI_PREFIXES:
        x = f"replace({x}, '{p}', '')"
    return d.tail(x, DOI_TAIL)


def dedup_key(d, doi, title, year):
    """doi: and the lower DOI without trailing dots, else title: and its ASCII letters and digits and the year."""
    own = d.tail(f"lower({strip(d, f'coalesce({doi}, {chr(39)}{chr(39)})')})", ".")
    return f"case when coalesce({doi}, '') <> '' then concat('doi:', {own}) else concat('title:', {d.ra(f'lower({title})', '[^a-z0-9]+', '')}, ':', coalesce(cast({year} as varchar(20)), 'None')) end"


def canonicalize(d, x):
    """Lower, without quotes, hyphens and spaces, one plural s, then four suffixes one after the other."""
    x = strip(d, f"lower({x})")
    for mark in ('"', "''"):
        x = d.ra(x, f"^{mark}+|{mark}+$", "") if d.name == "duckdb" else d.ra(x, f"^[{mark[:1] if mark == '"' else chr(92) + 'x27'}]+|[{mark[:1] if mark == '"' else chr(92) + 'x27'}]+$", "")
    for c in ("-", " "):
        x = f"replace({x}, '{c}', '')"
    x = f"case when {x} like '%s' and {x} not like '%ss' then substr({x}, 1, length({x}) - 1) else {x} end"
    for suffix in CANONICAL:
        x = d.ra(x, f"{suffix}$", "")
    return x


def stems(d, x):
    """Distinct stems of the words [a-zA-Z0-9-]+ of at least 3 letters that are no stop words."""
    stop = ", ".join(f"'{w}'" for w in STOP)
    words = d.keep(d.rxall(f"lower({x})", "[a-z0-9-]+"), "w", f"length(w) >= 3 and w not in ({stop})")
    cases = " ".join(f"when w like '%{e}' and length(w) >= {len(e) + 3} then substr(w, 1, length(w) - {len(e)})" for e in STEMS)
    return d.distinct(d.map(words, "w", f"case {cases} else w end"))


def jaccard(d, a, b):
    return f"case when {d.size(a)} = 0 or {d.size(b)} = 0 then 0e0 else cast({d.size(d.both(a, b))} as double) / {d.size(d.union(a, b))} end"


def cache_key(d, x):
    return f"substr({d.sha(f'lower({strip(d, x)})')}, 1, 16)"


def quoted(d, x):
    """In quotes if it holds a space or hyphen, after old quotes are dropped."""
    bare = f"replace({x}, '\"', '')"
    return f"case when {d.has(bare, '[ -]')} then concat('\"', {bare}, '\"') else {bare} end"


def sql_list(d, words):
    return d.arr(*("'" + w.replace("'", "''") + "'" for w in words))
