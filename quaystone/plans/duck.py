"""The same semantics as SQL fragments for the oracle. Written apart from the column functions, on the other engine's own terms."""

from __future__ import annotations

from .. import constants as C


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(items) -> str:
    return ", ".join(q(x) for x in items)


def draw(field: str, of: int, key: str = "payment_id", seed: int = 0) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || {key} || ':{field}'), 1, 8))::BIGINT % {of})"


def pick(options, field: str) -> str:
    return f"([{values(options)}])[{draw(field, len(options))} + 1]"


def codes(x: str) -> str:
    return f"list_transform(string_split({x}, ''), lambda c: CAST(ascii(c) AS BIGINT))"


def mod97(x: str) -> str:
    return f"list_reduce(list_prepend(0::BIGINT, {codes(x)}), lambda a, d: CASE WHEN d < 58 THEN (a * 10 + d - 48) % 97 ELSE (a * 100 + d - 55) % 97 END)"


def compact(x: str) -> str:
    return f"upper(regexp_replace({x}, '\\s+', '', 'g'))"


def alnum(x: str) -> str:
    return f"upper(regexp_replace({x}, '[^A-Za-z0-9]', '', 'g'))"


def iban_valid(x: str) -> str:
    c = compact(x)
    return f"coalesce(CASE WHEN regexp_full_match({c}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{1,30}}') THEN {mod97(f'substr({c}, 5) || substr({c}, 1, 4)')} = 1 ELSE false END, false)"


def bic_valid(x: str) -> str:
    return f"coalesce(regexp_full_match(upper(trim({x})), '[A-Z]{{6}}[A-Z0-9]{{2}}([A-Z0-9]{{3}})?'), false)"


def bic_country_valid(x: str) -> str:
    return f"({bic_valid(x)} AND coalesce(substr(upper(trim({x})), 5, 2) IN ({values(C.ISO_3166)}), false))"


def minor_units_ok(amount: str, currency: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {n}" for k, n in C.MINOR_UNITS.items())
    return f"(CASE WHEN strpos({amount}, '.') > 0 THEN length({amount}) - strpos({amount}, '.') ELSE 0 END = CASE {currency} {cases} ELSE 2 END)"


def fmt2(x: str) -> str:
    return f"printf('%.2f', {x})"


def norm_amount(x: str) -> str:
    t = f"replace(replace(trim({x}), ' ', ''), ' ', '')"
    tail = lambda c: f"length(string_split({t}, '{c}')[-1])"
    dots = f"(length({t}) - length(replace({t}, '.', '')))"
    plain = f"""CASE
      WHEN contains({t}, ',') AND contains({t}, '.') THEN CASE WHEN {tail(",")} < {tail(".")} THEN replace(replace({t}, '.', ''), ',', '.') ELSE replace({t}, ',', '') END
      WHEN contains({t}, ',') THEN CASE WHEN {tail(",")} = 3 AND length({t}) > 4 THEN replace({t}, ',', '') ELSE replace({t}, ',', '.') END
      WHEN {tail(".")} = 3 AND {dots} > 1 THEN replace({t}, '.', '') ELSE {t} END"""
    return f"coalesce(CASE WHEN regexp_full_match({plain}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN {fmt2(f'TRY_CAST({plain} AS DOUBLE)')} END, '')"


def norm_date(x: str) -> str:
    t = f"trim({x})"
    text = "(?i)^(\\d{1,2})\\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\s+(\\d{4})$"
    dmy = "^(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{4})$"
    g = lambda p, i: f"regexp_extract({t}, '{p}', {i})"
    a, b = f"TRY_CAST({g(dmy, 1)} AS INTEGER)", f"TRY_CAST({g(dmy, 2)} AS INTEGER)"
    month = f"(strpos('{''.join(C.MONTHS).lower()}', lower({g(text, 2)})) + 2) // 3"
    two = lambda v: f"lpad(CAST({v} AS VARCHAR), 2, '0')"
    return f"""coalesce(CASE
      WHEN regexp_matches({t}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN {t}
      WHEN regexp_matches({t}, '{text}') THEN {g(text, 3)} || '-' || {two(month)} || '-' || {two(f"TRY_CAST({g(text, 1)} AS INTEGER)")}
      WHEN regexp_matches({t}, '{dmy}') THEN {g(dmy, 3)} || '-' || CASE WHEN {a} <= 12 AND {b} > 12 THEN {two(a)} || '-' || {two(b)} ELSE {two(b)} || '-' || {two(a)} END
      END, '')"""


def date_in(x: str) -> str:
    found = ", ".join(f"nullif(regexp_extract({x}, '{p}', 0), '')" for p in (C.DATE_ISO, C.DATE_TEXT, C.DATE_DMY))
    return f"coalesce({norm_date(f'coalesce({found})')}, '')"


def currency_from(x: str) -> str:
    return f"regexp_extract({x}, '(?:^|[\\s,])([A-Z]{{3}})(?:$|[\\s,])', 1)"


def coerce(key: str, x: str) -> str:
    bare = f"replace({x}, ' ', '')"
    if key == "Amt_InstdAmt":
        return norm_amount(f"regexp_extract({x}, '(\\S+)\\s*$', 1)")
    if key == "Amt_InstdAmt_Ccy":
        return currency_from(x)
    if key == "ReqdExctnDt_Dt":
        return f"coalesce(nullif({norm_date(x)}, ''), {date_in(x)})"
    if key in ("CdtrAcct_IBAN", "DbtrAcct_IBAN"):
        return f"regexp_extract({bare}, '{C.IBAN}', 0)"
    if key.endswith("_BICFI"):
        return f"regexp_extract({bare}, '{C.BIC}', 0)"
    if key == "PmtId_EndToEndId":
        return f"regexp_replace(regexp_extract({x}, '^\\s*(\\S+)', 1), '^[,;]+|[,;]+$', '', 'g')"
    return x


def coerce_strict(key: str, x: str) -> str:
    if key == "ReqdExctnDt_Dt":
        return norm_date(x)
    if key in ("CdtrAcct_IBAN", "DbtrAcct_IBAN"):
        return f"regexp_extract({compact(x)}, '[A-Z]{{2}}\\d{{2}}[A-Z0-9]{{11,30}}', 0)"
    return x if key.endswith("_BICFI") else coerce(key, x)


def labelled(label: str, separators: str, text: str = "text") -> str:
    escaped = label.replace("-", "\\-")
    return f"trim(regexp_extract({text}, '(?im)^\\s*{escaped}\\s*{separators}\\s*(.+?)\\s*$', 1))"


def payments(source: str = "orders") -> str:
    """CTEs up to p: the payments."""
    country = lambda side, i: f"([{values(str(c[i]) for c in C.COUNTRIES)}])[{draw(f'{side}.country', len(C.COUNTRIES))} + 1]"
    digits = lambda field: f"lpad(CAST({draw(field, 10**8)} AS VARCHAR), 8, '0')"
    bban = lambda side: f"substr({digits(f'{side}.bban0')} || {digits(f'{side}.bban1')} || {digits(f'{side}.bban2')}, 1, CAST({country(side, 1)} AS INTEGER))"
    iban = lambda side: f"{side}_c || lpad(CAST(98 - {mod97(f'{side}_b || {side}_c || {q("00")}')} AS VARCHAR), 2, '0') || {side}_b"
    return f"""o AS (SELECT o_orderkey AS payment_id, o_totalprice, o_orderdate FROM {source}),
o2 AS (SELECT *, {country("Cdtr", 0)} AS Cdtr_c, {bban("Cdtr")} AS Cdtr_b, {country("Dbtr", 0)} AS Dbtr_c, {bban("Dbtr")} AS Dbtr_b FROM o),
p AS (SELECT payment_id,
  {pick(C.COMPANIES + C.PERSONS, "Cdtr.name")} AS "Cdtr_Nm", {iban("Cdtr")} AS "CdtrAcct_IBAN",
  {country("Cdtr", 2)} || CASE WHEN {draw("bic.branch", 2)} = 0 THEN '' ELSE lpad(CAST({draw("bic.digits", 1000)} AS VARCHAR), 3, '0') END AS "CdtrAgt_BICFI",
  Cdtr_c AS country, {pick(C.COMPANIES, "Dbtr.name")} AS "Dbtr_Nm", {iban("Dbtr")} AS "DbtrAcct_IBAN", {fmt2("o_totalprice")} AS "Amt_InstdAmt",
  ([{values(C.CURRENCIES)}])[payment_id % {len(C.CURRENCIES)} + 1] AS "Amt_InstdAmt_Ccy", 'E2E' || lpad(CAST(payment_id AS VARCHAR), 6, '0') AS "PmtId_EndToEndId",
  strftime(o_orderdate, '%Y-%m-%d') AS "ReqdExctnDt_Dt", replace({pick(C.PHRASES, "phrase")}, '{{n}}', CAST({draw("phrase.n", 90000)} + 10000 AS VARCHAR)) AS "RmtInf_Ustrd" FROM o2)"""


def text(level: str = "difficulty") -> str:
    lines = []
    for key, labels in C.LABELS.items():
        v = f'"{key}"'
        if key == "Amt_InstdAmt":
            us = f"format('{{:,.2f}}', CAST({v} AS DOUBLE))"
            v = f"(CASE WHEN {level} = 'clean' THEN {us} ELSE translate({us}, ',.', '.,') END)"
        if key == "ReqdExctnDt_Dt":
            y, m, d = f"substr({v}, 1, 4)", f"substr({v}, 6, 2)", f"substr({v}, 9, 2)"
            v = f"(CASE WHEN {level} = 'clean' THEN {v} ELSE ([{d} || '/' || {m} || '/' || {y}, {d} || ' ' || ([{values(C.MONTHS)}])[CAST({m} AS INTEGER)] || ' ' || {y}, {m} || '/' || {d} || '/' || {y}])[{draw('date.style', 3)} + 1] END)"
        label = f"CASE WHEN {level} = 'clean' THEN {q(labels[0])} ELSE {pick(labels, key + '.label')} END"
        shown = f"\"Amt_InstdAmt_Ccy\" || ' ' || {v}" if key == "Amt_InstdAmt" else v
        line = f"{label} || ': ' || {shown}"
        if key in C.BURIED:
            line = f"CASE WHEN {level} = 'hostile' THEN replace(replace({pick(C.PROSE, key + '.prose')}, '{{c}}', \"Amt_InstdAmt_Ccy\"), '{{v}}', {v}) ELSE {line} END"
        lines.append(line)
    for i in range(4):
        n = lambda field, low, count, i=i: f"CAST({draw(f'noise{i}.{field}', count)} + {low} AS VARCHAR)"
        noise = f"([{n('a', 1000, 99000)}, {n('b', 10, 90)} || '-' || {n('c', 100000, 900000)}, '+44 ' || {n('d', 100000000, 900000000)}, 'GB' || {n('e', 10, 90)} || 'BUKB' || {n('f', 10000000, 90000000)}])[{draw(f'noise{i}.style', 4)} + 1]"
        when = f"{level} = 'hostile'" if i >= 2 else f"{level} <> 'clean'"
        lines.append(f"CASE WHEN {when} THEN {pick(C.DISTRACTORS, f'noise{i}.label')} || ': ' || {noise} END")
    keyed = ",\n    ".join(f"sha256('0:' || payment_id || ':line{i}') || ({x})" for i, x in enumerate(lines))
    return f"array_to_string(list_transform(list_sort(list_filter([\n    {keyed}], lambda x: x IS NOT NULL)), lambda x: substr(x, 65)), chr(10))"


def level_of(x: str) -> str:
    return f"([{values(C.LEVELS)}])[{x} % {len(C.LEVELS)} + 1]"


def docs() -> str:
    """CTEs up to d: a document for each payment."""
    return f"""{payments()},
d0 AS (SELECT *, {level_of("payment_id")} AS difficulty FROM p),
d AS (SELECT *, {text()} AS text FROM d0)"""




def extracted(source: str = "d", rules: str = "rules_v2", name: str = "e", prefix: str = "got_", methods: bool = False) -> str:
    """CTEs from ``source`` to ``name``: with a column for each field."""
    if rules == "rules_v1":
        raw = ", ".join(f"{labelled(labels[0], ':')} AS r_{k}" for k, labels in C.LABELS.items())
        found = {k: coerce_strict(k, f"r_{'Amt_InstdAmt' if k == 'Amt_InstdAmt_Ccy' else k}") for k in C.KEYS}
        cols = ", ".join(f'{v} AS "{prefix}{k}"' for k, v in found.items())
        drop = ", ".join(f"r_{k}" for k in C.LABELS)
        return f"{name}_r AS MATERIALIZED (SELECT *, {raw} FROM {source}),\n{name} AS MATERIALIZED (SELECT * EXCLUDE ({drop}), {cols} FROM {name}_r)"
    raw, drop = [], []
    for k, labels in C.LABELS.items():
        for i, label in enumerate(labels):
            raw.append(f"{labelled(label, '[:\\-]')} AS r_{k}_{i}")
            drop.append(f"r_{k}_{i}")
    fixed = ", ".join(f"nullif({coerce(k, f'r_{k}_{i}')}, '') AS c_{k}_{i}" for k, labels in C.LABELS.items() for i in range(len(labels)))
    short = "x <> '' AND length(regexp_replace(string_split(x, '.')[1], '^0+', '')) <= 7"
    amounts = f"list_filter(list_transform(regexp_extract_all(text, '{C.AMOUNT}'), lambda x: {norm_amount('x')}), lambda x: {short})"
    ibans = f"list_filter(regexp_extract_all(replace(text, ' ', ''), '{C.IBAN}'), lambda x: {iban_valid('x')})"
    dates = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {date_in('x')}), lambda x: x <> '')"
    fallback = {
        "Amt_InstdAmt_Ccy": (currency_from("text"), "pattern"),
        "Amt_InstdAmt": (f"coalesce({amounts}[1], '')", "pattern"),
        "CdtrAcct_IBAN": ("coalesce(ib[1], '')", "pattern-guess"),
        "DbtrAcct_IBAN": ("coalesce(list_filter(ib, lambda x: x <> ib[1])[1], '')", "pattern-guess"),
        "CdtrAgt_BICFI": (f"regexp_extract(text, '{C.BIC}', 0)", "pattern-guess"),
        "ReqdExctnDt_Dt": (f"coalesce({dates}[1], '')", "pattern"),
        "PmtId_EndToEndId": (f"regexp_extract(text, '{C.REFERENCE}', 0)", "pattern"),
    }
    cols = []
    for k in C.KEYS:
        tries = [f"c_{k}_{i}" for i in range(len(C.LABELS.get(k, ())))]
        other, how = fallback.get(k, ("''", None))
        cols.append(f'coalesce({", ".join([*tries, other])}) AS "{prefix}{k}"')
        if methods:
            cases = " ".join(f"WHEN c_{k}_{i} IS NOT NULL THEN {q('label-ambiguous' if label.lower() in C.AMBIGUOUS_LABELS else 'label')}" for i, label in enumerate(C.LABELS.get(k, ())))
            last = f"WHEN {other} <> '' THEN {q(how)}" if how else ""
            cols.append(f'CASE {cases} {last} ELSE NULL END AS "how_{k}"')
    gone = ", ".join(["ib", *(x.replace("r_", "c_", 1) for x in drop)])
    return f"""{name}_r AS MATERIALIZED (SELECT *, {", ".join(raw)}, {ibans} AS ib FROM {source}),
{name}_c AS MATERIALIZED (SELECT * EXCLUDE ({", ".join(drop)}), {fixed} FROM {name}_r),
{name} AS MATERIALIZED (SELECT * EXCLUDE ({gone}), {", ".join(cols)} FROM {name}_c)"""


def scored(source: str = "e", name: str = "s", prefix: str = "got_") -> str:
    """CTE with the score of each row; here every field is stated, so that nothing is invented."""
    right = " + ".join(f'CAST(coalesce("{k}", \'\') <> \'\' AND "{prefix}{k}" = "{k}" AS INTEGER)' for k in C.KEYS)
    expected = " + ".join(f"CAST(coalesce(\"{k}\", '') <> '' AS INTEGER)" for k in C.KEYS)
    invented = " + ".join(f"CAST(coalesce(\"{k}\", '') = '' AND \"{prefix}{k}\" <> '' AS INTEGER)" for k in C.KEYS)
    return f"{name} AS MATERIALIZED (SELECT *, {right} AS correct, {expected} AS expected, {invented} AS n_invented, ({expected}) - ({right}) AS n_wrong FROM {source})"


def cells(source: str = "s", keep: str = "payment_id", prefix: str = "got_") -> str:
    """Long form: (kept columns, field, want, got)."""
    return "\nUNION ALL ".join(f"SELECT {keep}, '{k}' AS field, coalesce(\"{k}\", '') AS want, \"{prefix}{k}\" AS got FROM {source}" for k in C.KEYS)


def rate(a: str, b: str) -> str:
    return f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0), 6)"
