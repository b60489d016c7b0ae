"""Word lists, thresholds and patterns that results depend on."""

# --- fixed values: missing-value markers -----------------------------------
PLACEHOLDER_MARKERS = [
    "", "-", "--", "na", "n/a", "nan", "nd", "n d", "none", "null",
    "not available", "not determined", "not reported", "not sequenced",
    "unknown", "unavailable",
]
AUDIT_EMPTY_MARKERS = PLACEHOLDER_MARKERS + ["not applicable", "not done"]
MISSING_TOKENS = ["", "na", "nan", "none", "null", "nd", "n/a", "unknown"]

# --- fixed values: alphabets -------------------------------------------------
CANONICAL_RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
HYDROPHOBIC = "AVILMFWY"
AROMATIC = "FWY"
CHARGED = "DEKRH"
ACIDIC = "DE"
BASIC = "KRH"

# --- fixed values: patterns ----------------------------------------------------
TARGET_MENTION = r"sars[\s_-]*cov[\s_-]*2|sarscov2"
TARGET_MENTION_WIDE = r"sars[\s_-]*cov[\s_-]*2|sarscov2|2019[\s_-]*ncov|covid[\s_-]*19"
SINGLE_DOMAIN_TYPE = r"\b(?:nb|nanobody|vhh)\b"
FLAG_RBD = r"\brbd\b"
FLAG_NTD = r"\bntd\b"
FLAG_SPIKE = r"\bspike\b|(?:^|[;\s,/+])s(?:$|[;\s,/+])"
FLAG_SPIKE_SIMPLE = r"\bspike\b|^s$"

# --- fixed values: bounds and thresholds ---------------------------------------
HEAVY_LENGTHS = (80, 180)
LIGHT_LENGTHS = (60, 140)
SPLIT_SEED = 42
TEST_FRACTION = 0.2
INNER_FRACTION = 0.15
MIN_SOURCE_ROWS = 30
MIN_CLASS_ROWS = 5
MIN_VARIANT_ROWS = 300
MIN_VARIANT_GROUPS = 4
MAX_TERMS = 50_000
THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.9]
TOP_K = [25, 50, 100, 250]
ENRICHMENT_K = [50, 100, 500]
BUDGETS = [25, 50, 100, 200, 500]
DIVERSITY_LIMIT = 0.95
SHORTLIST_SIZE = 25
COMPOSITE_WEIGHTS = {
    "retrieval_score": 0.40,
    "max_similarity": 0.30,
    "top10_similarity": 0.20,
    "centroid_similarity": 0.10,
}

# --- fixed values: column names ------------------------------------------------
RAW_RENAMES = {
    "Name": "antibody_name",
    "Ab or Nb": "antibody_type",
    "VHorVHH": "heavy_or_vhh_sequence",
    "VL": "light_sequence",
    "CDRH3": "cdrh3",
    "CDRL3": "cdrl3",
    "Protein + Epitope": "protein_epitope",
    "Origin": "origin",
    "Structures": "structures",
    "Sources": "sources",
    "Date Added": "date_added",
    "Last Updated": "last_updated",
}
POSITIONAL_NAMES = {
    0: "sample_name", 1: "sample_type",
    2: "metadata_positive_text", 3: "metadata_negative_text",
    4: "label_positive_text", 5: "label_negative_text",
    6: "metadata_target_region", 7: "metadata_origin",
    8: "sequence_a", 9: "sequence_b",
    10: "group_feature_v", 11: "group_feature_j",
    12: "group_feature_b_v", 13: "group_feature_b_j",
    14: "group_feature_cdr3", 15: "group_feature_b_cdr3",
    16: "metadata_structure", 17: "metadata_model",
    18: "metadata_sources", 19: "metadata_date_added",
    20: "metadata_last_updated",
}
ALIAS_NAMES = {
    "sequence_heavy_only": "sequence_a",
    "sequence_pair_text": "sequence_pair_text",
    "label": "label",
    "heavy_or_vhh_sequence": "sequence_a_raw",
    "light_sequence": "sequence_b",
    "cdrh3": "group_feature_cdr3",
    "cdrl3": "group_feature_b_cdr3",
    "protein_epitope": "metadata_target_region",
    "antibody_name": "sample_name",
    "antibody_type": "sample_type",
}
NEUTRAL_ORDER = [
    "sample_name", "sample_type", "label", "label_positive_text",
    "label_negative_text", "metadata_positive_text", "metadata_negative_text",
    "sequence_a", "sequence_b", "sequence_a_raw", "sequence_pair_text",
    "sequence_key", "group_feature_v", "group_feature_j", "group_feature_b_v",
    "group_feature_b_j", "group_feature_cdr3", "group_feature_b_cdr3",
    "metadata_target_region", "metadata_origin", "metadata_structure",
    "metadata_model", "metadata_sources", "metadata_date_added",
    "metadata_last_updated",
]
METADATA_JOIN_COLUMNS = [
    "group_feature_v", "group_feature_j", "group_feature_b_v",
    "group_feature_b_j", "group_feature_cdr3", "group_feature_b_cdr3",
    "metadata_target_region", "metadata_origin",
]
HEAVY_COLUMN_CANDIDATES = [
    "sequence_alignment_aa_heavy", "v_sequence_alignment_aa_heavy",
    "sequence_aa_heavy", "heavy_sequence",
]
LIGHT_COLUMN_CANDIDATES = [
    "sequence_alignment_aa_light", "v_sequence_alignment_aa_light",
    "sequence_aa_light", "light_sequence",
]
SOURCE_COLUMN_CANDIDATES = [
    "sources", "Sources", "source", "study", "paper", "publication",
    "metadata_source", "metadata_origin", "Date Added", "date_added",
]
FORBIDDEN_PUBLIC_COLUMNS = [
    "sequence", "heavy_sequence", "light_sequence", "sequence_pair_text",
    "vhorvhh", "vl",
]
SEQUENCE_COLUMNS = [
    "sequence_a", "sequence_b", "sequence_a_raw", "sequence_pair_text",
    "sequence_heavy_only", "heavy_sequence", "light_sequence",
    "group_feature_cdr3", "group_feature_b_cdr3", "existing_cdrh3",
    "existing_cdrl3", "cdrh1_seq", "cdrh2_seq", "cdrh3_seq", "cdrl1_seq",
    "cdrl2_seq", "cdrl3_seq", "marked_heavy_text", "marked_light_text",
    "whole_pair_kmer_text", "all_cdr_kmer_text", "cdrh3_cdrl3_kmer_text",
    "cdrh3", "cdrh3_prefix", "cdrh3_suffix",
]
ROLE_KEYWORDS = {
    "antibody_name": ["name", "antibody name", "antibody", "ab name", "clone"],
    "heavy_chain_sequence": [
        "vh or vhh", "heavy chain sequence", "heavy sequence", "vh sequence",
        "vhh sequence", "variable heavy", "heavy variable", "vh", "vhh",
    ],
    "light_chain_sequence": [
        "vl", "light chain sequence", "light sequence", "variable light",
        "light variable", "kappa", "lambda",
    ],
    "bind_target_antigen": [
        "binds to", "does not bind", "doesn't bind", "binding", "target",
        "antigen", "virus", "protein",
    ],
    "sars_cov_2": [
        "sars-cov-2", "sars cov 2", "sars_cov_2", "sarscov2", "covid-19", "2019-ncov",
    ],
    "neutralisation": [
        "neutralising", "neutralizing", "neutralisation", "neutralization", "neut",
    ],
    "pdb_or_structure": ["pdb", "structure", "structures"],
    "epitope": ["epitope", "protein epitope", "protein + epitope", "binding site"],
}
ROLE_SEQUENCE_EXCLUDES = [
    "cdr", "gene", "germline", "model", "pdb", "source", "structure", "date",
]
NEGATIVE_NAME_MARKERS = ["not", "non", "doesn", "doesnt", "lack", "negative"]

# --- fixed values: label words ---------------------------------------------------
LABEL_WORDS = {
    "positive": 1, "pos": 1, "true": 1, "yes": 1,
    "neutralising": 1, "neutralizing": 1,
    "negative": 0, "neg": 0, "false": 0, "no": 0,
    "non-neutralising": 0, "non-neutralizing": 0,
}
