"""Result extraction from calculation logs: narrow projections over whole-file text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, is_true, let, orbital_gap, spin_contamination
from ..records import ANGSTROM_PER_BOHR, EV_PER_HARTREE
from .text import NUMBER, last_number, lines_of, to_number

# ---- fixed values: phrases of the log format ---------------------------------
NORMAL_END = "ORCA TERMINATED NORMALLY"
ERROR_END = "ORCA finished by error termination|ORCA TERMINATED ABNORMALLY"
SCF_FAILED = "SCF NOT CONVERGED|SCF DID NOT CONVERGE|SCF failed to converge"
SCF_DONE = "SCF CONVERGED AFTER|SCF CONVERGENCE ACHIEVED|Energy Check signals convergence"
FINAL_ENERGY = rf"^\s*FINAL SINGLE POINT ENERGY\s+({NUMBER})\s*$"
VERSION = r"Program Version\s+([A-Za-z0-9_.+-]+)"
CYCLES = r"SCF CONVERGED AFTER\s+(\d+)\s+CYCLES"
SPIN_SQUARE = rf"Expectation value of <S(?:\*\*|\^)?2>\s*:?\s*({NUMBER})"
FOD_NUMBER = rf"N_FOD\s*=\s*({NUMBER})"
PRINTED_GAP = rf"HOMO-LUMO GAP\s*[:=]\s*({NUMBER})\s*eV"
SMEARED = r"N_FOD|SMEAR(?:TEMP|ING)"
ORBITAL_TITLE = r"(?im)^\s*ORBITAL ENERGIES\s*$"
ORBITAL_HEADER = r"(?i)NO\s+OCC\s+E\(Eh\)\s+E\(eV\)"
ORBITAL_ROW = rf"^\s*\d+\s+({NUMBER})\s+({NUMBER})\s+({NUMBER})(?:\s|$)"
MESSAGES = {
    "scf": "SCF did not converge",
    "end": "missing/ambiguous normal termination or explicit error",
    "energies": "expected exactly one final single-point energy",
    "unconfirmed": "no recognized SCF-convergence confirmation",
    "correlation": "no match for reviewed correlated-method convergence pattern",
}
# ---- end of fixed values -----------------------------------------------------


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(f"(?im){pattern}"))


def orbital_table_gap(text) -> Column:
    """Smallest gap over the spin channels of the only orbital table; NULL whenever it is not clear-cut."""
    text = col(text)
    after = F.split(text, ORBITAL_TITLE)[1]
    pieces = F.split(after, ORBITAL_HEADER)
    tables = F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1)))

    def kind(line: Column) -> Column:
        return F.when(line.rlike(ORBITAL_ROW), "r").when(F.trim(line) == "", "b").otherwise("x")

    def rows(lines: Column, kinds: Column, start: Column) -> Column:
        """From the first orbital row up to the first other non-blank line."""
        stop = F.locate("x", F.substring(kinds, start, F.length(kinds)))
        length = F.when(stop > 0, stop - 1).otherwise(F.size(lines))
        return F.filter(F.slice(lines, F.greatest(start, F.lit(1)), length), lambda l: l.rlike(ORBITAL_ROW))

    def channel(part: Column) -> Column:
        found = let(lines_of(part), lambda lines: let(
            F.concat_ws("", F.transform(lines, kind)), lambda kinds: let(
                F.instr(kinds, "r"), lambda start: F.when(start > 0, rows(lines, kinds, start)))))
        return F.transform(found, lambda l: F.struct(
            to_number(F.regexp_extract(l, ORBITAL_ROW, 1)).alias("occ"), to_number(F.regexp_extract(l, ORBITAL_ROW, 3)).alias("ev")))

    def smallest(channels: Column) -> Column:
        whole = F.forall(channels, lambda c: F.forall(c, lambda r: F.abs(r["occ"] - F.round(r["occ"])) <= 1e-5))
        return let(
            F.transform(channels, lambda c: orbital_gap(F.transform(c, lambda r: r["ev"]), F.transform(c, lambda r: r["occ"]))),
            lambda gaps: F.when((F.size(channels) > 0) & is_true(whole) & F.forall(gaps, lambda g: g.isNotNull()), F.array_min(gaps)))

    usable = (_count(text, SMEARED) == 0) & (F.regexp_count(text, F.lit(ORBITAL_TITLE)) == 1)
    return F.when(usable, let(F.filter(F.transform(tables, channel), lambda c: F.size(c) > 0), smallest))


def extract_run_logs(logs: DataFrame, text: str = "text", multiplicity: str = "multiplicity") -> DataFrame:
    """Adds status, energy_hartree, software_version, message and diagnostics to (…, text, multiplicity).

    Anything ambiguous (two energies, two endings) is a status of its own, never a guess.
    """
    body = F.col(text)
    energies = F.regexp_extract_all(body, F.lit("(?im)" + FINAL_ENERGY), F.lit(1))
    df = logs.withColumns({
        "_scf_failed": _count(body, SCF_FAILED) > 0,
        "_ended": (_count(body, NORMAL_END) == 1) & (_count(body, ERROR_END) == 0),
        "_energies": energies,
        "_confirmed": _count(body, SCF_DONE) > 0,
        "_s2": last_number(body, SPIN_SQUARE),
    })
    ladder = [
        (F.col("_scf_failed"), "nonconverged", "scf"),
        (~F.col("_ended"), "failed", "end"),
        (F.size("_energies") != 1, "unsupported", "energies"),
        (~F.col("_confirmed"), "nonconverged", "unconfirmed"),
    ]
    status, message = F.lit("succeeded"), F.lit("")
    for condition, outcome, why in reversed(ladder):
        status = F.when(condition, outcome).otherwise(status)
        message = F.when(condition, MESSAGES[why]).otherwise(message)
    version = F.regexp_extract(body, "(?i)" + VERSION, 1)
    table_gap = orbital_table_gap(body)
    gap = F.coalesce(table_gap, F.when(_count(body, SMEARED) == 0, last_number(body, PRINTED_GAP)))
    df = df.withColumns({"status": status, "message": message})
    return df.withColumns({
        "energy_hartree": F.when(F.col("status") == "succeeded", to_number(F.try_element_at("_energies", F.lit(1)))),
        "software_version": F.when(version == "", "unknown").otherwise(version),
        "scf_converged": F.col("_confirmed") & ~F.col("_scf_failed"),
        "scf_cycles": last_number(body, CYCLES),
        "s2": F.col("_s2"),
        "spin_contamination": spin_contamination("_s2", multiplicity),
        "fod": last_number(body, FOD_NUMBER),
        "homo_lumo_gap_ev": gap,
    }).drop("_scf_failed", "_ended", "_energies", "_confirmed", "_s2")


def demand_correlation_pattern(results: DataFrame, pattern: str, text: str = "text", fidelity: str = "fidelity") -> DataFrame:
    """High-level results need their own convergence line; without it they count as not converged."""
    lacking = (F.col(fidelity) == "high_level") & (F.col("status") == "succeeded") & ~F.col(text).rlike(f"(?m){pattern}")
    return results.withColumns({
        "energy_hartree": F.when(~lacking, F.col("energy_hartree")),
        "message": F.when(lacking, MESSAGES["correlation"]).otherwise(F.col("message")),
        "status": F.when(lacking, "nonconverged").otherwise(F.col("status")),
    })


def extract_gradients(files: DataFrame, text: str = "text", atoms: str = "atom_count") -> DataFrame:
    """Adds ``forces_ev_angstrom`` (n x 3) and ``gradient_problem`` from gradient files in Eh/bohr."""
    lines = F.filter(F.transform(lines_of(text), lambda l: F.trim(l)), lambda l: (l != "") & ~l.startswith("#"))
    n = F.col(atoms)
    df = files.withColumn("_lines", lines)
    df = df.withColumn("_g", F.transform(F.slice("_lines", 3, 3 * n), to_number))
    problem = (
        F.when((F.size("_lines") < 2 + 3 * n) | ~is_true(F.try_element_at("_lines", F.lit(1)).try_cast("int") == n),
               "malformed atom count or gradient block")
        .when(F.exists("_g", lambda v: v.isNull()), "a gradient is not a number")
    )
    scale = -EV_PER_HARTREE / ANGSTROM_PER_BOHR
    forces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.slice("_g", i * 3 + 1, 3), lambda v: v * F.lit(scale)))
    return df.withColumn("gradient_problem", problem).withColumn(
        "forces_ev_angstrom", F.when(F.col("gradient_problem").isNull(), forces)).drop("_lines", "_g")
