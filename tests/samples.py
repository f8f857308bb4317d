"""Small hand-built registries. Identifiers are generated, none belongs to a company."""

from __future__ import annotations

from registra.sources.registry import registry_from_frames


def luhn_digit(body: str) -> str:
    total = 0
    for i, ch in enumerate(reversed(body)):
        d = int(ch)
        if i % 2 == 0:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return str((10 - total % 10) % 10)


def siren(n: int) -> str:
    body = f"{40000000 + n}"
    return body + luhn_digit(body)


def siret(n: int, k: int) -> str:
    body = siren(n) + f"{k:04d}"
    return body + luhn_digit(body)


EST = "siret string, siren string, etatAdministratifEtablissement string, etablissementSiege string, dateDebut string, dateCreationEtablissement string, numeroVoieEtablissement string, libelleVoieEtablissement string, codePostalEtablissement string"
UNIT = "siren string, denominationUniteLegale string, nomUniteLegale string, prenom1UniteLegale string"
LINK = "siretPredecesseur string, siretSuccesseur string, dateLienSuccession string, continuiteEconomique string"
HIST = "siret string, siren string, dateDebut string, dateFin string"


def est(n, k, state="A", head=False, start=None, created=None, number="1", street="RUE", zip_code="75001"):
    return (siret(n, k), siren(n), state, str(head).lower(), start, created, number, street, zip_code)


def registry(spark, establishments, units=(), links=None, history=None):
    def frame(rows, schema):
        return None if rows is None else spark.createDataFrame(list(rows), schema)

    known = {u[0] for u in units}
    units = list(units) + [
        (s, f"COMPANY {s}", None, None) for s in sorted({e[1] for e in establishments}) if s not in known
    ]
    return registry_from_frames(
        frame(establishments, EST), frame(units, UNIT), frame(links, LINK), frame(history, HIST)
    )


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
