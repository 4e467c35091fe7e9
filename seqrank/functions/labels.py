"""Rule-based labels of proteins and motifs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqrank.functions.numeric import col
from seqrank.functions.sequence import letter_count, letter_fraction, rna

# ---------------------------------------------------------------------------
# Results must carry these exact labels, prefixes and thresholds.
PLANT_SPECIES = ["ARATH", "ORYSJ", "ORYSA", "MAIZE", "SOLLC"]
FUNGI_SPECIES = ["YEAST", "SCHPO", "CANAL", "ASPOR", "NEUCR"]
ANIMAL_SPECIES = ["HUMAN", "MOUSE", "DROME", "CAEEL", "DANRE", "XENLA"]
KINGDOM_NAMES = {0: "animal", 1: "plant", 2: "fungi", 3: "other"}
UC_PROBES = ["CUUCUCU", "UUUCUCU", "CUCUCUU", "UCUCUCU", "UUCUCUU", "CUCUUCU"]
G_PROBES = ["UGGAGUG", "UAGAACG", "AGUAGGA", "GAUUGGA", "GGAUGGA", "GAUGGAA"]
CONTROL_FAMILIES = ["PPR_control", "dsRNA_control", "AGO_control", "DICER_control", "other_control"]
CONTROL_PROTEINS = ["AtGRP7", "AtGRP8", "w5"]
VALIDATION_PROTEINS = ["w6", "AtAPUM23"]
HARD_FAILURE = "w5"
RETAINED_PROTEINS = ["w1", "w2", "w3", "w4", "w6"]
PUMILIO_PROTEINS = ["AtAPUM5", "AtAPUM6", "AtAPUM23"]
REPORTED_PROTEIN = "AtCPSF30"
FAILURE_MODES = {
    "PUF/APUM": "main failure family; prior fallback improves but leave-family-out remains weak",
    "polyA_processing": "truth shortage and complex-level signal ambiguity",
    "PPR_control": "control family not suitable for strict linear motif loss",
    "dsRNA_control": "control family not suitable for strict linear motif loss",
    "AGO_control": "control family not suitable for strict linear motif loss",
    "DICER_control": "control family not suitable for strict linear motif loss",
}
OTHER_FAILURE = "mixed"
FAMILY_MARKS = [
    (["APUM", "PUF"], "PUF/APUM"),
    (["CPSF", "CFIM", "FIP1", "FPA", "HLP1", "polyA"], "polyA_processing"),
    (["GRP"], "GRP/RRM"),
    (["PPR"], "PPR_control"),
    (["AGO"], "AGO_control"),
    (["DCL", "Dicer"], "DICER_control"),
    (["DRB", "HYL1", "OsDRB1"], "dsRNA_control"),
    (["control", "diagnostic"], "other_control"),
]
EXPECTED_MARKS = [
    (["PUF", "UGUA", "UUGA"], "PUF_like_UGUA_UUGA"),
    (["AAUAAA", "polyA", "A_rich"], "A_rich_polyA"),
    (["CFIm"], "UGUA_like_CFIm"),
    (["UC"], "UC-rich"),
    (["U-rich"], "U-rich"),
    (["PPR"], "PPR_long_target_control"),
    (["DRB", "HYL1", "structure", "AGO"], "dsRNA_structure_control"),
    (["diagnostic"], "diagnostic_only"),
]
UNSCORED_EXPECTATIONS = [
    "PPR_long_target_control",
    "dsRNA_structure_control",
    "diagnostic_only",
    "guide-dependent_control",
]
PROTEIN_ALIASES = {
    "LOC_Os05g24160.1": "OsDRB1",
    "OsDRB1": "OsDRB1",
    "AtCFI25_or_CFIm_like": "AtCFIM25",
    "AtCFI25/CFIm_like": "AtCFIM25",
    "AtCFI25 / CFIm-like": "AtCFIM25",
    "AtCFIM25 / CFIm-like": "AtCFIM25",
    "AtHYL1/DRB1": "AtHYL1_DRB1",
    "ARATH|GRP7|Q03250|Glycine-rich_RNA-binding_protein_7": "AtGRP7",
    "ARATH|GRP8|Q03251|Glycine-rich_RNA-binding_protein_8": "AtGRP8",
    "ARATH|HYL1|O04492|Double-stranded_RNA-binding_protein_1": "AtHYL1_DRB1",
    "ORYSJ|LOC_Os05g24160.1|Q0DJA3|original_rice7": "OsDRB1",
    "ARATH|AGO1|O04379|Protein_argonaute_1": "AtAGO1",
    "ARATH|AGO4|Q9ZVD5|Protein_argonaute_4": "AtAGO4",
    "ARATH|AGO7|Q9C793|Protein_argonaute_7": "AtAGO7",
    "ORYSJ|AGO18|Q69UP6|Protein_argonaute_18": "OsAGO18",
    "ARATH|DRB4|Q8H1D4|Double-stranded_RNA-binding_protein_4": "AtDRB4",
    "ARATH|DCL1|Q9SP32|Endoribonuclease_Dicer_homolog_1": "AtDCL1",
    "ARATH|DCL4|P84634|Dicer-like_protein_4": "AtDCL4",
}
SHORT_PROTEINS = ["GRP7", "GRP8", "HYL1", "DRB4", "DCL1", "DCL4"]
# ---------------------------------------------------------------------------


def has_any(text: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in marks])


def first_mark(text: Column, rules: list[tuple[list[str], str]], otherwise: Column) -> Column:
    out = F
    for marks, label in rules:
        out = out.when(has_any(text, marks), label)
    return out.otherwise(otherwise)


def kingdom_of_species(query_id: str | Column) -> Column:
    """Kingdom code from the species prefix of a pipe-separated id; 3 when unknown."""
    prefix = F.upper(F.split_part(col(query_id), F.lit("|"), F.lit(1)))
    return (
        F.when(prefix.isin(PLANT_SPECIES), 1)
        .when(prefix.isin(FUNGI_SPECIES), 2)
        .when(prefix.isin(ANIMAL_SPECIES), 0)
        .otherwise(3)
    )


def kingdom_of_species_older(query_id: str | Column) -> Column:
    """Two-way form: 1 for plants, else 0."""
    return F.when(kingdom_of_species(query_id) == 1, 1).otherwise(0)


def kingdom_with_fallback(query_id: str | Column, fallback: int = 1) -> dict[str, Column]:
    code = kingdom_of_species(query_id)
    label = F.when(code == 3, F.lit(fallback)).otherwise(code)
    names = F.create_map(*[F.lit(x) for pair in KINGDOM_NAMES.items() for x in pair])
    return {
        "kingdom_label": label,
        "kingdom_name": F.coalesce(F.try_element_at(names, label), F.lit("other")),
        "kingdom_source": F.when(code == 3, "fallback_label").otherwise("query_protein_id_prefix"),
    }


def kingdom_of_taxonomy(text: str | Column) -> Column:
    low = F.lower(col(text))
    return (
        F.when(has_any(low, ["viridiplantae", "plant"]), 1)
        .when(has_any(low, ["fung"]), 2)
        .when(has_any(low, ["metazoa", "animal"]), 0)
        .otherwise(3)
    )


def physico_chemical(protein: str | Column) -> dict[str, Column]:
    """Length in thousands and shares of G, R and K; an empty protein gives zeros."""
    text = col(protein)
    out = {"length_kaa": F.length(text) / F.lit(1000.0)}
    for letter in "GRK":
        out[f"fraction_{letter}"] = F.coalesce(letter_fraction(text, letter), F.lit(0.0))
    return out


def motif_flags(kmer: str | Column) -> dict[str, Column]:
    """Whether a k-mer is rich in U, U+C, A or G."""
    text = rna(kmer)
    n = F.length(text)

    def rich(letters: str, least: int, part: float) -> Column:
        return letter_count(text, letters) >= F.greatest(F.lit(least), F.ceil(n * F.lit(part)).cast("int"))

    # Minimum count and minimum share of each class.
    return {"U": rich("U", 3, 0.55), "UC": rich("UC", 4, 0.75), "A": rich("A", 3, 0.55), "G": rich("G", 3, 0.45)}


def motif_group(kmer: str | Column) -> Column:
    """Group of a k-mer; the first matching rule wins, so UGUA always counts as PUF-like."""
    text, rich = rna(kmer), motif_flags(kmer)
    return (
        F.when(has_any(text, ["UGUA", "UUGA"]), "PUF_like_UGUA_UUGA")
        .when(has_any(text, ["AAUAAA", "AUUAAA"]), "A_rich_polyA")
        .when(rich["UC"], "UC-rich")
        .when(rich["U"], "U-rich")
        .when(rich["A"], "A-rich")
        .when(rich["G"], "G-rich")
        .otherwise("Other")
    )


def family_bucket(protein: str | Column, family: str | Column, expected: str | Column) -> Column:
    name = col(protein)
    text = F.concat_ws(" ", F.coalesce(col(family), F.lit("")), F.coalesce(col(expected), F.lit("")), name)
    return F.when(name.startswith("w"), "RBNS_lab").otherwise(first_mark(text, FAMILY_MARKS, F.lit("unknown")))


def expected_group(expected: str | Column) -> Column:
    text = F.coalesce(col(expected), F.lit(""))
    return first_mark(text, EXPECTED_MARKS, F.when(text == "", "unknown").otherwise(text))


def collapse_status(expected: str | Column, predicted: str | Column) -> Column:
    e, p = col(expected), col(predicted)
    return (
        F.when(e.isin("U-rich", "UC-rich"), "expected_U_UC_family")
        .when(e.isin(UNSCORED_EXPECTATIONS), "not_applicable_control")
        .when(p.isin("U-rich", "UC-rich"), "collapsed_to_U_UC")
        .otherwise("not_collapsed")
    )


def canonical_protein(raw: str | Column) -> Column:
    """Short protein name of an alias or pipe-separated id; other text is kept."""
    text = F.trim(col(raw))
    aliases = F.create_map(*[F.lit(x) for pair in PROTEIN_ALIASES.items() for x in pair])
    species = F.split_part(text, F.lit("|"), F.lit(1))
    name = F.split_part(text, F.lit("|"), F.lit(2))
    rule = (
        F.when(name.startswith("At"), name)
        .when(name.startswith("LOC_Os05g24160"), "OsDRB1")
        .when(name.startswith("AGO") & (species == "ARATH"), F.concat(F.lit("At"), name))
        .when(name.startswith("AGO") & (species == "ORYSJ"), F.concat(F.lit("Os"), name))
        .when(
            name.isin(SHORT_PROTEINS),
            F.concat(
                F.when(species == "ARATH", "At").otherwise("Os"),
                name,
                F.when(name == "HYL1", "_DRB1").otherwise(""),
            ),
        )
    )
    known = F.coalesce(
        F.try_element_at(aliases, text),
        F.when(text.contains("|"), F.coalesce(F.try_element_at(aliases, F.substring_index(text, "|", 4)), rule)),
        text,
    )
    return F.when(text.isNull() | (text == "") | (text == "nan"), "").otherwise(known)


def motif_tokens(text: str | Column) -> Column:
    """RNA words of 4 to 16 letters found in free text."""
    found = F.regexp_extract_all(F.upper(col(text)), F.lit("([ACGUTN]{4,16})"), F.lit(1))
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda t: F.translate(t, "T", "U"))


def is_control(family: str | Column, protein: str | Column) -> Column:
    return col(family).isin(CONTROL_FAMILIES) | col(protein).isin(CONTROL_PROTEINS)


