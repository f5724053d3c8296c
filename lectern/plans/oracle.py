"""Expected words as DuckDB expressions, from literals of their own: nothing here is taken from the operators."""

from __future__ import annotations


def listed(words: str | list[str]) -> str:
    values = words.split("|") if isinstance(words, str) else words
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# Fixed values.
EN_TO_19 = listed("zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen")
EN_TENS = listed("||twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety")
DE_TO_19 = listed("null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|zehn|elf|zwölf|dreizehn|vierzehn|fünfzehn|sechzehn|siebzehn|achtzehn|neunzehn")
DE_TENS = listed("||zwanzig|dreißig|vierzig|fünfzig|sechzig|siebzig|achtzig|neunzig")
EN_DAY = listed(
    "first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|eleventh|twelfth|thirteenth|fourteenth|fifteenth|sixteenth|seventeenth|eighteenth|nineteenth|twentieth|"
    "twenty-first|twenty-second|twenty-third|twenty-fourth|twenty-fifth|twenty-sixth|twenty-seventh|twenty-eighth|twenty-ninth|thirtieth|thirty-first"
)
DE_DAY = listed(
    "erst|zweit|dritt|viert|fünft|sechst|siebt|acht|neunt|zehnt|elft|zwölft|dreizehnt|vierzehnt|fünfzehnt|sechzehnt|siebzehnt|achtzehnt|neunzehnt|zwanzigst|"
    "einundzwanzigst|zweiundzwanzigst|dreiundzwanzigst|vierundzwanzigst|fünfundzwanzigst|sechsundzwanzigst|siebenundzwanzigst|achtundzwanzigst|neunundzwanzigst|dreißigst|einunddreißigst"
)
EN_MONTH = listed("January|February|March|April|May|June|July|August|September|October|November|December")
DE_MONTH = listed("Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember")
FR_DAY = listed(
    "un|deux|trois|quatre|cinq|six|sept|huit|neuf|dix|onze|douze|treize|quatorze|quinze|seize|dix-sept|dix-huit|dix-neuf|vingt|vingt et un|vingt-deux|vingt-trois|"
    "vingt-quatre|vingt-cinq|vingt-six|vingt-sept|vingt-huit|vingt-neuf|trente|trente et un"
)
FR_90S = listed("quatre-vingt-dix|quatre-vingt-onze|quatre-vingt-douze|quatre-vingt-treize|quatre-vingt-quatorze|quatre-vingt-quinze|quatre-vingt-seize|quatre-vingt-dix-sept|quatre-vingt-dix-huit|quatre-vingt-dix-neuf")


def en_below_100(n: str) -> str:
    return f"(CASE WHEN {n} < 20 THEN {EN_TO_19}[{n} + 1] ELSE {EN_TENS}[{n} // 10 + 1] || CASE WHEN {n} % 10 = 0 THEN '' ELSE '-' || {EN_TO_19}[{n} % 10 + 1] END END)"


def de_below_100(n: str) -> str:
    one = f"CASE {n} % 10 WHEN 0 THEN '' WHEN 1 THEN 'einund' ELSE {DE_TO_19}[{n} % 10 + 1] || 'und' END"
    return f"(CASE WHEN {n} < 20 THEN {DE_TO_19}[{n} + 1] ELSE {one} || {DE_TENS}[{n} // 10 + 1] END)"


def en_below_1000(n: str) -> str:
    low = en_below_100(f"({n} % 100)")
    return f"(CASE WHEN {n} < 100 THEN {low} ELSE {EN_TO_19}[{n} // 100 + 1] || ' hundred' || CASE WHEN {n} % 100 = 0 THEN '' ELSE ' and ' || {low} END END)"


def en_number(n: str) -> str:
    """Whole numbers below 1,000,000,000."""
    parts = f"nullif(concat_ws(', ', CASE WHEN {n} >= 1000000 THEN {en_below_1000(f'({n} // 1000000)')} || ' million' END, CASE WHEN {n} // 1000 % 1000 > 0 THEN {en_below_1000(f'({n} // 1000 % 1000)')} || ' thousand' END), '')"
    rest = f"({n} % 1000)"
    return (
        f"(CASE WHEN {n} < 1000 THEN {en_below_1000(rest)} WHEN {rest} = 0 THEN {parts} WHEN {rest} < 100 THEN {parts} || ' and ' || {en_below_100(rest)} "
        f"ELSE {parts} || ', ' || {en_below_1000(rest)} END)"
    )


def de_below_1000(n: str, last: bool) -> str:
    """last: the number ends here, so a one is eins."""
    low = de_below_100(f"({n} % 100)")
    low = low if last else f"(CASE WHEN {n} % 100 = 1 THEN 'ein' ELSE {low} END)"
    return f"(CASE WHEN {n} < 100 THEN {low} ELSE CASE {n} // 100 WHEN 1 THEN 'ein' ELSE {DE_TO_19}[{n} // 100 + 1] END || 'hundert' || CASE WHEN {n} % 100 = 0 THEN '' ELSE {low} END END)"


def de_number(n: str) -> str:
    """Whole numbers below 1,000,000,000."""
    m, t, r = f"({n} // 1000000)", f"({n} // 1000 % 1000)", f"({n} % 1000)"
    million = f"CASE {m} WHEN 0 THEN NULL WHEN 1 THEN 'eine Million' ELSE {de_below_1000(m, True)} || ' Millionen' END"
    rest = f"CASE WHEN {n} % 1000000 = 0 AND {n} > 0 THEN NULL ELSE CASE WHEN {t} = 0 THEN '' ELSE {de_below_1000(t, False)} || 'tausend' END || CASE WHEN {r} = 0 AND {n} > 0 THEN '' ELSE {de_below_1000(r, True)} END END"
    return f"concat_ws(' ', {million}, {rest})"


def en_year(y: str) -> str:
    low, high = f"({y} % 100)", f"({y} // 100)"
    return (
        f"(CASE WHEN {y} = 2000 THEN 'two thousand' WHEN {y} BETWEEN 2001 AND 2009 THEN 'two thousand ' || {en_below_100(low)} WHEN {low} = 0 THEN {en_below_100(high)} || ' hundred' "
        f"WHEN {low} < 10 THEN {en_below_100(high)} || ' oh ' || {en_below_100(low)} ELSE {en_below_100(high)} || ' ' || {en_below_100(low)} END)"
    )


def de_year(y: str) -> str:
    low, high = f"({y} % 100)", f"({y} // 100)"
    return f"(CASE WHEN {y} >= 2000 THEN 'zweitausend' ELSE {de_below_100(high)} || 'hundert' END || CASE WHEN {low} = 0 THEN '' ELSE {de_below_100(low)} END)"


def spelled(digits: str, words: str) -> str:
    """Each digit of a text as a word."""
    return f"array_to_string([{words}[d::INTEGER + 1] FOR d IN string_split({digits}, '')], ' ')"


#: DuckDB: the numeric tokens of whole texts (id, lang, source, token, free): tags are opaque, and a token's
#: neighbours are the gap and the token beyond it.
TOKENS_SQL = r"""
cut AS (SELECT doc_id, lang, source, regexp_extract_all(text, p) AS m, regexp_split_to_array(text, p) AS g
        FROM documents, (SELECT '<[^>]*>|\[[^\]]*\]|[-−–—]?[0-9]+(?:[.,][0-9]+)?' AS p) WHERE regexp_matches(text, '[0-9]')),
each AS (SELECT doc_id, lang, source, m[i] AS token,
         CASE WHEN i = 1 OR m[i - 1][1] IN ('<', '[') THEN '' ELSE m[i - 1] END || g[i] AS l,
         g[i + 1] || CASE WHEN i = len(m) OR m[i + 1][1] IN ('<', '[') THEN '' ELSE m[i + 1] END AS r
         FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM cut)),
tokens AS (SELECT doc_id, lang, source, token, NOT (
           regexp_matches(l, '[\p{L}\p{N}_.,:/+\-−–—]$') OR regexp_matches(r, '^(?:[\p{L}\p{N}_:/+\-−–—]|[.,][0-9])')
           OR (regexp_matches(l, '(?:^|[^0-9])[0-9]{1,3}[ \x{A0}\x{202F}\x{2009}]$') AND regexp_matches(token, '^[0-9]{3}(?:[^0-9]|$)'))
           OR (regexp_matches(r, '^[ \x{A0}\x{202F}\x{2009}][0-9]{3}(?:[^0-9]|$)') AND regexp_matches(token, '(?:^|[^0-9])[0-9]{1,3}$'))) AS free,
           regexp_replace(token, '^[-−–—]', '') AS bare FROM each WHERE token[1] NOT IN ('<', '[')),
kinds AS (SELECT *, CASE WHEN NOT free OR NOT regexp_matches(bare, '^[0-9]{1,9}(?:[.,][0-9]{1,6})?$') THEN 'rejected' WHEN regexp_matches(bare, '^0[0-9]+$') THEN 'digits'
          WHEN regexp_matches(bare, '^[0-9]+$') THEN 'integer' ELSE 'decimal' END AS kind FROM tokens)
"""
