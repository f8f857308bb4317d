"""The same results in plain SQL, written independently of the Spark jobs.

Each query names the common table expressions it needs by using them; `sql` adds those and what they
use in turn. Row-by-row comparisons and recursion are fine here: this is the check, not the job.
"""

from __future__ import annotations

import re


def check_digit(body: str, length: int) -> str:
    terms = []
    for i in range(1, length + 1):
        d = f"CAST(substr({body},{i},1) AS INTEGER)"
        doubled = (length - i) % 2 == 0
        terms.append(f"(2*{d} - CASE WHEN {d} > 4 THEN 9 ELSE 0 END)" if doubled else d)
    return f"CAST((10 - ({' + '.join(terms)}) % 10) % 10 AS VARCHAR)"


def luhn(number: str) -> str:
    d = f"CAST(substr({number}, i, 1) AS INTEGER)"
    weighted = (
        f"CASE WHEN (length({number}) - i) % 2 = 1 THEN CASE WHEN 2*{d} > 9 THEN 2*{d} - 9 ELSE 2*{d} END ELSE {d} END"
    )
    total = f"list_sum([{weighted} for i in range(1, length({number}) + 1)])"
    return f"coalesce(regexp_full_match({number}, '0*[1-9][0-9]*') AND {total} % 10 = 0, false)"


def key_valid(number: str) -> str:
    total = f"list_sum([CAST(substr({number}, i, 1) AS INTEGER) for i in range(1, length({number}) + 1)])"
    postal = f"(length({number}) = 14 AND {number} LIKE '356000000%' AND {total} % 5 = 0)"
    return f"({luhn(number)} OR coalesce({postal}, false))"


LEGAL_FORMS = r"\b(SAS|SARL|SA|SNC|EURL|SASU|SCI|GIE|EI)\b"


def without_form(name: str) -> str:
    return f"trim(regexp_replace(upper({name}), '{LEGAL_FORMS}', '', 'g'))"


RECENT_FIRST = "siege DESC, debut DESC NULLS LAST, creation DESC NULLS LAST, siret ASC"
OWN_STATUS = "CASE etat WHEN 'A' THEN 'ACTIVE' WHEN 'F' THEN 'CLOSED' ELSE 'FOUND_UNKNOWN_STATUS' END"
STATUS_LABEL = """CASE {0} WHEN 'ACTIVE' THEN 'Actif' WHEN 'CLOSED' THEN 'Fermé' WHEN 'INVALID_SIRET_FORMAT' THEN 'Invalide'
    WHEN 'NOT_FOUND_IN_SIRENE' THEN 'Non trouvé' ELSE 'Radiée' END"""

COMMON = {
    "unit": f"""SELECT *, concat(b, {check_digit('b', 8)}) AS siren
        FROM (SELECT *, CAST(30000000 + c_custkey AS VARCHAR) AS b FROM customer)""",
    "etab": f"""SELECT o_orderkey, o_custkey, rn, siren, concat(p, {check_digit('p', 13)}) AS siret, o_orderpriority, c_nationkey, n_name,
        substr(concat(p, {check_digit('p', 13)}), 10, 5) AS nic,
        CASE WHEN o_orderkey % 50 = 7 THEN NULL WHEN o_custkey % 7 = 0 THEN 'F' WHEN o_orderstatus = 'O' THEN 'A' ELSE 'F' END AS etat,
        (rn = 1 AND o_custkey % 11 <> 0) AS siege,
        CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS creation,
        CASE WHEN o_orderkey % 9 <> 4 THEN concat(year(o_orderdate), '-01-01') END AS debut,
        CAST(rn AS VARCHAR) AS numero, c_mktsegment AS type_voie,
        CASE o_orderkey % 40 WHEN 0 THEN '[ND]' WHEN 20 THEN '[ nd ]' ELSE o_orderpriority END AS voie,
        lpad(CAST(c_nationkey * 100 + rn % 3 AS VARCHAR), 5, '0') AS cp,
        CASE WHEN o_orderkey % 13 = 0 THEN concat('ENSEIGNE ', c_mktsegment) END AS enseigne
        FROM (SELECT *, concat(siren, lpad(CAST(rn AS VARCHAR), 4, '0')) AS p
              FROM (SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders o)
              JOIN unit ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "ul": """SELECT siren, c_custkey, c_nationkey,
        CASE WHEN c_custkey % 13 = 0 THEN 'C' ELSE 'A' END AS etat_ul,
        CASE WHEN c_custkey % 10 IN (3, 6) THEN NULL WHEN c_custkey % 10 = 7 THEN ''
             ELSE concat(upper(p_name), CASE c_custkey % 4 WHEN 0 THEN ' SAS' WHEN 1 THEN ' SARL' WHEN 2 THEN ' SA' ELSE '' END) END AS denom,
        CASE WHEN c_custkey % 10 = 7 THEN upper(p_name) END AS usuelle1,
        CASE WHEN c_custkey % 10 = 6 THEN concat('SG', c_custkey) END AS sigle,
        CASE WHEN c_custkey % 10 IN (3, 6) THEN upper(c_name) END AS nom,
        CASE WHEN c_custkey % 10 = 3 THEN 'JEAN' END AS prenom1,
        CASE WHEN c_custkey % 20 = 3 THEN 'nan' END AS prenom2,
        concat('47.', c_custkey % 100) AS ape
        FROM unit LEFT JOIN part ON p_partkey = c_custkey""",
    "company": """SELECT siren, coalesce(nullif(denom, ''), usuelle1, sigle, concat_ws(' ', prenom1, nom)) AS nom_entreprise FROM ul""",
    "lnk": """SELECT p.siret AS pred, s.siret AS succ, CASE WHEN p.o_orderkey % 19 = 0 THEN '' ELSE s.creation END AS d,
          p.o_orderkey % 2 = 0 AS cont, s.siege AS head
          FROM etab p JOIN etab s ON s.siren = p.siren AND s.rn = p.rn + 1 WHERE p.etat = 'F'
        UNION ALL SELECT p.siret, s.siret, s.creation, true, s.siege
          FROM etab p JOIN etab s ON s.o_orderkey = p.o_orderkey + 1
          WHERE p.etat = 'F' AND p.o_orderpriority IN ('1-URGENT', '2-HIGH')
        UNION ALL SELECT s.siret, p.siret, s.creation, false, false
          FROM etab p JOIN etab s ON s.siren = p.siren AND s.rn = p.rn + 1
          WHERE p.etat = 'F' AND s.etat = 'F' AND s.o_orderpriority = '5-LOW'
        UNION ALL SELECT siret, concat(siren, '99999'), '2030-01-01', false, false FROM etab WHERE etat = 'F' AND rn = 3""",
    "hist": """SELECT siret, siren, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS debut,
        CASE WHEN l_linestatus <> 'O' THEN CAST(CAST(CAST(l_shipdate AS DATE) + INTERVAL 30 DAY AS DATE) AS VARCHAR) END AS fin
        FROM lineitem JOIN etab ON l_orderkey = o_orderkey""",
    "inp": """SELECT o_orderkey AS row_id, CAST(o_orderkey AS VARCHAR) AS ref,
        CASE o_orderkey % 10 WHEN 0 THEN siret WHEN 1 THEN siren
          WHEN 2 THEN concat('SIRET ', substr(siret, 1, 3), ' ', substr(siret, 4, 6), '-', substr(siret, 10, 5))
          WHEN 3 THEN concat(siren, '99999') WHEN 4 THEN concat('1', substr(siret, 2, 13)) WHEN 5 THEN '' WHEN 6 THEN '00000'
          WHEN 7 THEN concat(siret, '.0') WHEN 8 THEN '804172633'
          ELSE coalesce(lag(siret) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), siret) END AS identifiant,
        CASE o_orderkey % 6 WHEN 0 THEN 'FR' WHEN 1 THEN 'France' WHEN 2 THEN 'DE' WHEN 3 THEN '' WHEN 4 THEN '0' ELSE 'FRA' END AS pays,
        n_name AS list_siren FROM etab""",
    "namelist": """SELECT c_custkey AS row_id,
        CASE WHEN c_custkey % 50 = 0 THEN 'SA' ELSE concat(substr(n, 1, 2), substr(n, 4, 1), substr(n, 3, 1), substr(n, 5)) END AS nom,
        CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_nationkey * 100 + 1 AS VARCHAR), 5, '0') ELSE '' END AS zip,
        CASE c_custkey % 3 WHEN 0 THEN 'FR' WHEN 1 THEN 'DE' ELSE 'france' END AS pays
        FROM (SELECT *, coalesce(nullif(denom, ''), usuelle1, nom) AS n FROM ul)""",
    "val": f"""SELECT *, CASE WHEN type = 'SIREN' THEN substr(digits, 1, 9) ELSE norm END AS key,
          CASE WHEN type = 'SIRET' THEN 'SIRET_OK' WHEN type = 'SIREN' AND length(digits) = 9 THEN 'SIREN_DIRECT'
               WHEN type = 'SIREN' THEN 'SIREN_FALLBACK_FROM_SIRET' ELSE 'INVALID' END AS route
        FROM (SELECT *, CASE WHEN length(norm) = 14 AND {key_valid('norm')} THEN 'SIRET'
                     WHEN length(digits) >= 9 AND {key_valid('substr(digits, 1, 9)')} THEN 'SIREN' ELSE '' END AS type
          FROM (SELECT *, substr(digits, 1, 14) AS norm
            FROM (SELECT *, regexp_replace(identifiant, '[^0-9]', '', 'g') AS digits FROM inp)))""",
    "scoped": """SELECT *, CASE WHEN lower(trim(pays)) IN ('fr', 'fra', 'france') THEN 'home'
          WHEN regexp_full_match(trim(pays), '0*') THEN 'unknown' ELSE 'foreign' END AS scope FROM val""",
    "analysed": "SELECT * FROM val WHERE NOT regexp_full_match(digits, '0*')",
    "pick": f"""SELECT siren, siret, etat, CASE WHEN siege THEN 'SIREN_SIEGE' ELSE 'SIREN_ACTIVE_FALLBACK' END AS mode
        FROM etab WHERE siege OR etat = 'A' QUALIFY row_number() OVER (PARTITION BY siren ORDER BY {RECENT_FIRST}) = 1""",
    "cnt": """SELECT siren, count(*) AS total, count(*) FILTER (etat = 'A') AS actifs, count(*) FILTER (etat = 'F') AS fermes
        FROM etab GROUP BY siren""",
    "lines": """SELECT a.*, coalesce(e.siret, k.siret) AS siret, coalesce(e.siren, k.siren) AS siren,
          CASE WHEN e.siret IS NOT NULL THEN e.etat ELSE k.etat END AS etat, k.mode
        FROM analysed a LEFT JOIN etab e ON a.type = 'SIRET' AND e.siret = a.key
        LEFT JOIN pick k ON a.type = 'SIREN' AND k.siren = a.key""",
    "stat": f"""SELECT l.*, coalesce(total, 0) AS total, coalesce(actifs, 0) AS actifs, coalesce(fermes, 0) AS fermes,
          count(*) OVER (PARTITION BY CASE WHEN type = 'SIRET' THEN key ELSE concat('#', row_id) END) > 1 AS dup_siret,
          type <> '' AND count(*) OVER (PARTITION BY CASE WHEN type <> '' THEN substr(key, 1, 9) ELSE concat('#', row_id) END) > 1 AS dup_siren,
          CASE WHEN type = '' THEN 'INVALID_SIRET_FORMAT' WHEN siret IS NULL THEN 'NOT_FOUND_IN_SIRENE'
               WHEN etat = 'F' AND coalesce(actifs, 0) = 0 THEN 'RADIATED' ELSE {OWN_STATUS} END AS status
        FROM lines l LEFT JOIN cnt USING (siren)""",
    "best": "SELECT pred, succ FROM lnk QUALIFY row_number() OVER (PARTITION BY pred ORDER BY d DESC, cont DESC, succ) = 1",
    "walk": """SELECT DISTINCT norm AS start, norm AS cur, [norm] AS seen, CAST(NULL AS VARCHAR) AS found, 0 AS depth
          FROM stat WHERE status = 'CLOSED'
        UNION ALL SELECT w.start, b.succ, list_append(w.seen, b.succ),
          CASE WHEN coalesce(e.etat, '') IN ('', 'A') THEN b.succ END, w.depth + 1
        FROM walk w JOIN best b ON b.pred = w.cur LEFT JOIN etab e ON e.siret = b.succ
        WHERE w.found IS NULL AND w.depth < 5 AND NOT list_contains(w.seen, b.succ)""",
    "sib": f"""SELECT row_id, e.siret AS sibling, count(*) OVER (PARTITION BY row_id) AS n,
          CASE WHEN count(*) OVER (PARTITION BY row_id) = 1 THEN 'only active establishment of the legal unit'
               WHEN e.siege THEN 'head office among several active establishments'
               WHEN e.debut IS NOT NULL THEN 'latest start date among several active establishments'
               ELSE 'latest creation date among several active establishments' END AS reason
        FROM stat s JOIN etab e ON e.siren = s.siren AND e.etat = 'A' AND (e.siret <> s.norm OR s.actifs = 1)
        QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY e.siege DESC, e.debut DESC NULLS LAST, e.creation DESC NULLS LAST, e.siret) = 1""",
    "dec0": """SELECT s.*, sibling, coalesce(n, 0) AS n, reason, found AS succ, depth AS hops,
          CASE WHEN status = 'CLOSED' THEN coalesce(found, sibling) END AS repl
        FROM stat s LEFT JOIN sib USING (row_id)
        LEFT JOIN (SELECT start, found, depth FROM walk WHERE found IS NOT NULL) ON start = norm AND status = 'CLOSED'""",
    "dec": """SELECT *,
          CASE WHEN status <> 'CLOSED' THEN NULL WHEN succ IS NOT NULL THEN 'Succession'
               WHEN sibling IS NOT NULL THEN 'Autre SIRET même SIREN' ELSE 'Aucun' END AS source,
          CASE status WHEN 'ACTIVE' THEN 'Conserver' WHEN 'INVALID_SIRET_FORMAT' THEN 'Invalide' WHEN 'NOT_FOUND_IN_SIRENE' THEN 'Non trouvé'
               WHEN 'RADIATED' THEN 'Radiée' WHEN 'CLOSED' THEN CASE WHEN repl IS NULL THEN 'A clôturer' ELSE 'Remplacer' END
               ELSE 'A analyser' END AS action,
          CASE WHEN repl IS NOT NULL THEN CASE WHEN left(repl, 9) <> left(norm, 9) THEN 'Oui' ELSE 'Non' END END AS alert,
          CASE WHEN status IN ('INVALID_SIRET_FORMAT', 'NOT_FOUND_IN_SIRENE') OR repl IS NOT NULL THEN 'Haute'
               WHEN status = 'CLOSED' THEN 'Moyenne' ELSE 'Basse' END AS prio,
          CASE WHEN status = 'ACTIVE' THEN siret ELSE repl END AS retained
        FROM dec0""",
    "noted": """SELECT *, concat_ws(' ',
          CASE WHEN route = 'SIREN_FALLBACK_FROM_SIRET' THEN 'The 14-digit key fails; searched by the first 9 digits.' END,
          CASE mode WHEN 'SIREN_SIEGE' THEN 'SIREN given, head office used: ' || siret || '.'
                    WHEN 'SIREN_ACTIVE_FALLBACK' THEN 'SIREN given, no head office, active establishment used: ' || siret || '.' END,
          CASE WHEN status = 'INVALID_SIRET_FORMAT' THEN 'Identifier fails validation.'
               WHEN status = 'NOT_FOUND_IN_SIRENE' AND type = 'SIREN' THEN 'Valid SIREN without a usable establishment.'
               WHEN status = 'NOT_FOUND_IN_SIRENE' THEN 'Valid identifier absent from the registry.'
               WHEN status = 'ACTIVE' THEN 'Establishment is active.'
               WHEN source = 'Succession' THEN 'Establishment is closed; successor ' || repl || '.'
               WHEN source = 'Autre SIRET même SIREN' THEN 'Establishment is closed; sibling ' || repl || ' out of ' || n || ' active.'
               WHEN status = 'CLOSED' THEN 'Establishment is closed; no replacement.'
               ELSE 'Legal unit has no active establishment, or the state is unusual.' END,
          CASE WHEN source = 'Autre SIRET même SIREN' AND n > 1 THEN 'Reason: ' || reason || '.' END,
          CASE WHEN alert = 'Oui' THEN 'The replacement belongs to another legal unit; check before use.' END) AS note
        FROM dec""",
    "hsum": """SELECT siret, count(*) AS h_rows, max(debut) AS h_debut,
          CASE WHEN count(*) = count(fin) THEN max(fin) END AS h_fin FROM hist GROUP BY siret""",
    "policy": """SELECT d.*, x.siret AS shown, x.nic AS x_nic, x.etat AS x_etat, x.creation AS x_creation, x.debut AS x_debut, x.numero, x.type_voie,
          x.voie, x.cp, x.n_name, x.enseigne,
          CASE WHEN status <> 'CLOSED' THEN 'INPUT_SIRET_DATA' WHEN repl IS NULL THEN 'NO_DATA_CLOSED_NO_REPLACEMENT'
               WHEN x.siret IS NULL THEN 'NO_DATA_REPLACEMENT_NOT_LOADED' ELSE 'REPLACEMENT_SIRET_DATA' END AS applied,
          CASE WHEN status <> 'CLOSED' OR x.siren = d.siren THEN d.siren END AS shown_siren
        FROM noted d LEFT JOIN etab x ON x.siret = CASE WHEN status = 'CLOSED' THEN repl ELSE d.siret END""",
    "shown": """SELECT p.*, h.h_rows, h.h_debut, h.h_fin, u.etat_ul, u.denom, u.usuelle1, u.sigle, u.nom, u.prenom1, u.prenom2, u.ape, nom_entreprise,
          concat_ws(' ', numero, type_voie, voie, cp, n_name) AS adresse,
          shown_siren IS NOT NULL OR status <> 'CLOSED' AS described,
          coalesce(regexp_matches(voie, '\\[\\s*[nN][dD]\\s*\\]'), false) AS nd
        FROM policy p LEFT JOIN hsum h ON h.siret = p.siret LEFT JOIN ul u ON u.siren = shown_siren
        LEFT JOIN company c ON c.siren = shown_siren""",
    "cand": f"""SELECT e.siret, e.siren, cp, name AS denomination, {without_form('name')} AS clean,
          trim(concat_ws(' ', numero, type_voie, voie, cp, n_name)) AS adresse
        FROM (SELECT e.*, coalesce(nullif(denom, ''), nullif(usuelle1, ''), enseigne, nom) AS name FROM etab e JOIN ul u ON u.siren = e.siren) e""",
    "qname": f"""SELECT row_id, clean, zip FROM (SELECT *, {without_form('trim(nom)')} AS clean FROM namelist WHERE length(trim(nom)) >= 3)
        WHERE length(clean) >= 3""",
    "sim": """SELECT q.clean AS a, c.clean AS b, jaro_winkler_similarity(q.clean, c.clean) AS s
        FROM (SELECT DISTINCT clean FROM qname) q, (SELECT DISTINCT clean FROM cand WHERE clean IS NOT NULL) c""",
    "best_unit": """SELECT a, z, siren, siret, score FROM (
          SELECT q.clean AS a, q.zip AS z, c.siren, c.siret,
            round(least(1.0, s + CASE WHEN q.zip <> '' AND c.cp = q.zip THEN 0.05 ELSE 0 END), 10) AS score
          FROM (SELECT DISTINCT clean, zip FROM qname) q JOIN sim ON sim.a = q.clean JOIN
            (SELECT clean, cp, siren, min(siret) AS siret FROM cand GROUP BY 1, 2, 3) c ON c.clean = sim.b)
        QUALIFY row_number() OVER (PARTITION BY a, z, siren ORDER BY score DESC, siret) = 1""",
    "top3": """SELECT *, row_number() OVER (PARTITION BY a, z ORDER BY score DESC, siret) AS rank FROM best_unit
        QUALIFY row_number() OVER (PARTITION BY a, z ORDER BY score DESC, siret) <= 3""",
    "found3": """SELECT q.row_id, rank, t.siret, denomination, adresse, round(score, 4) AS score_similarite
        FROM qname q JOIN top3 t ON t.a = q.clean AND t.z = q.zip JOIN cand c ON c.siret = t.siret""",
    "wide3": """SELECT n.row_id, n.nom, n.zip AS code_postal, n.pays, """
    + ", ".join(
        f"coalesce(max(f.siret) FILTER (rank = {i}), '') AS suggested_siret_{i}, "
        f"coalesce(max(denomination) FILTER (rank = {i}), '') AS suggested_denomination_{i}, "
        f"coalesce(max(adresse) FILTER (rank = {i}), '') AS suggested_adresse_{i}, "
        f"max(score_similarite) FILTER (rank = {i}) AS score_{i}"
        for i in (1, 2, 3)
    )
    + """ FROM namelist n LEFT JOIN found3 f USING (row_id) GROUP BY ALL""",
}
RECURSIVE = ("walk",)


def uses(text: str) -> set[str]:
    return {name for name in COMMON if re.search(rf"\b{name}\b", text)}


def sql(final: str) -> str:
    """`final` preceded by the expressions it needs, in definition order."""
    needed: set[str] = set()
    open_names = uses(final)
    while open_names:
        name = open_names.pop()
        if name not in needed:
            needed.add(name)
            open_names |= uses(COMMON[name]) - needed
    if not needed:
        return final
    parts = [f"{name} AS ({COMMON[name]})" for name in COMMON if name in needed]
    keyword = "WITH RECURSIVE" if needed & set(RECURSIVE) else "WITH"
    return f"{keyword} {', '.join(parts)} {final}"
