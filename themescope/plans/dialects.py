"""Where the SQL of Spark and that of DuckDB differ. Braces are doubled: the SQL is formatted with its inputs."""

from __future__ import annotations

#: Fields of a piece of evidence in an answer.
EVIDENCE = ("class", "metaphor_level", "metaphor_type", "span", "weight", "reasoning")


class Duck:
    name = "duck"

    def json(self, x: str, key: str) -> str:
        """A field of a parsed answer as text."""
        return f"json_extract_string({x}, '$.{key}')"

    def strip(self, x: str) -> str:
        return rf"regexp_replace({x}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"

    def blank(self, x: str) -> str:
        """Whether a text is null or white space alone."""
        return rf"NOT coalesce(regexp_matches({x}, '[^\s\x0B]'), FALSE)"

    def ordered(self, value: str, order: str) -> str:
        return f"string_agg({value}, ', ' ORDER BY {order})"

    def distinct(self, value: str) -> str:
        """Different values in their own order, joined."""
        return f"string_agg(DISTINCT {value}, '; ' ORDER BY {value})"

    def parsed(self, x: str) -> str:
        """The answer in a body that is one JSON object and nothing else; null for any other body."""
        return f"CASE WHEN json_valid({x}) AND starts_with({x}, '{{{{') THEN {x} END"

    def first(self, value: str, weight: str, rank: str) -> str:
        """The value with the largest weight; on ties that of the smallest rank."""
        return f"first({value} ORDER BY {weight} DESC, {rank})"

    def with_quantiles(self, x: str, n: str, shares: tuple[float, ...], names: tuple[str, ...], source: str, group: str) -> str:
        """``source`` with the interpolated quantiles of its group beside each row; values stand ``n`` times each."""
        columns = ", ".join(f"quantile_cont({x}, {q}) AS {name}" for q, name in zip(shares, names, strict=True))
        quantiles = f"(SELECT {group} AS group_, {columns} FROM (SELECT {group}, {x}, unnest(range({n})) FROM {source}) GROUP BY {group})"
        return f"(SELECT * FROM {source} a JOIN {quantiles} b ON a.{group} IS NOT DISTINCT FROM b.group_)"

    def fixed(self, x: str, digits: int) -> str:
        """A double as text, its binary value rounded; in Spark ``functions.numbers.fixed()``."""
        return f"printf('%.{digits}f', {x})"

    def split1(self, x: str) -> str:
        return f"split_part({x}, ',', 1)"

    def starts(self, x: str, prefix: str) -> str:
        return f"starts_with({x}, '{prefix}')"

    def is_kind(self, x: str, key: str, kind: str) -> str:
        """Whether a field of a parsed answer is there and an OBJECT or an ARRAY."""
        return f"coalesce(json_type({x}, '$.{key}') = '{kind}', FALSE)"

    def entries(self, x: str) -> str:
        """How many scores and pieces of evidence an answer has, null where they are no object and no list."""
        return f"CASE WHEN {self.is_kind(x, 'scores', 'OBJECT')} THEN len(json_keys({x}, '$.scores')) END AS n_scores, CASE WHEN {self.is_kind(x, 'evidence', 'ARRAY')} THEN CAST(json_array_length({x}, '$.evidence') AS BIGINT) END AS n_evidence"

    def scores(self, source: str, keep: str) -> str:
        """A row (keep, theory, score) for each entry of the scores of ``answer``."""
        keys = f"SELECT {keep}, answer, unnest(json_keys(answer, '$.scores')) AS theory FROM {source} WHERE answer IS NOT NULL"
        return f"(SELECT {keep}, theory, CAST(json_extract_string(answer, concat('$.scores.', theory)) AS DOUBLE) AS score FROM ({keys}))"

    def evidence(self, source: str, keep: str) -> str:
        """A row (keep, position from 0, EVIDENCE) for each piece of evidence of ``answer``."""
        places = f"SELECT {keep}, answer, unnest(range(CAST(json_array_length(answer, '$.evidence') AS BIGINT))) AS position FROM {source} WHERE answer IS NOT NULL"
        fields = ", ".join(f"CAST(json_extract_string(answer, concat('$.evidence[', position, '].{f}')) AS {'DOUBLE' if f == 'weight' else 'VARCHAR'}) AS {f}" for f in EVIDENCE)
        return f"(SELECT {keep}, CAST(position AS INT) AS position, {fields} FROM ({places}))"


class Spark(Duck):
    name = "spark"

    def json(self, x: str, key: str) -> str:
        return f"try_variant_get({x}, '$.{key}', 'string')"

    def strip(self, x: str) -> str:
        return rf"regexp_replace({x}, r'(?U)^\s+|\s+$', '')"

    def blank(self, x: str) -> str:
        return rf"NOT coalesce({x} RLIKE r'(?U)\S', FALSE)"

    def ordered(self, value: str, order: str) -> str:
        return f"array_join(transform(sort_array(collect_list(CASE WHEN {value} IS NOT NULL THEN struct({order} AS k, {value} AS v) END)), x -> x.v), ', ')"

    def distinct(self, value: str) -> str:
        return f"array_join(array_sort(collect_set({value})), '; ')"

    def parsed(self, x: str) -> str:
        """A variant, parsed once. The body stands in a list before its own hash: only if it is one value with nothing
        behind it does the list have two elements, the second of them that hash. Signs that the parser takes before
        INF and Infinity, and JSON doesn't, are looked for outside strings. Of equal keys the last counts, if the
        session says so (``responses.session()``).
        """
        listed = f"from_json(concat('[', {x}, ', ', CAST(xxhash64({x}) AS STRING), ']'), 'array<variant>', map('allowSingleQuotes', 'false'))"
        alone = f"element_at(transform(array({listed}), a -> CASE WHEN size(a) = 2 AND try_variant_get(a[1], '$', 'bigint') = xxhash64({x}) THEN a[0] END), 1)"
        bare = rf"""regexp_replace({x}, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', '')"""
        odd = f"((contains({x}, 'INF') OR contains({x}, '+Inf')) AND {bare} RLIKE r'[-+]INF|[+]Inf')"
        return f"CASE WHEN startswith({x}, '{{{{') AND NOT {odd} THEN {alone} END"

    def is_kind(self, x: str, key: str, kind: str) -> str:
        return f"coalesce(startswith(schema_of_variant(variant_get({x}, '$.{key}', 'variant')), '{kind}'), FALSE)"

    def entries(self, x: str) -> str:
        return f"CAST(cardinality({self.score_map(x)}) AS BIGINT) AS n_scores, CAST(cardinality({self.pieces(x)}) AS BIGINT) AS n_evidence"

    def first(self, value: str, weight: str, rank: str) -> str:
        return f"min_by({value}, struct(-{weight} AS w, {rank} AS r))"

    def with_quantiles(self, x: str, n: str, shares: tuple[float, ...], names: tuple[str, ...], source: str, group: str) -> str:
        columns = ", ".join(f"percentile({x}, {q}, {n}) OVER (PARTITION BY {group}) AS {name}" for q, name in zip(shares, names, strict=True))
        return f"(SELECT *, {columns} FROM {source})"

    def starts(self, x: str, prefix: str) -> str:
        return f"startswith({x}, '{prefix}')"

    def scores(self, source: str, keep: str) -> str:
        return f"(SELECT {keep}, explode({self.score_map('answer')}) AS (theory, score) FROM {source})"

    def score_map(self, answer: str) -> str:
        """Scores by class; an entry that is no number is null, and so is the whole if it is no object."""
        return f"try_variant_get({answer}, '$.scores', 'map<string,double>')"

    def pieces(self, answer: str) -> str:
        """The evidence as a list of structs; an entry that is no object is null, a field of another kind too."""
        kinds = ", ".join(f"{f}: {'double' if f == 'weight' else 'string'}" for f in EVIDENCE)
        return f"try_variant_get({answer}, '$.evidence', 'array<struct<{kinds}>>')"

    def evidence(self, source: str, keep: str) -> str:
        rows = f"SELECT {keep}, posexplode({self.pieces('answer')}) AS (position, e) FROM {source}"
        return f"(SELECT {keep}, position, {', '.join(f'e.{f}' for f in EVIDENCE)} FROM ({rows}))"
