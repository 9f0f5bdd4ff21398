"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from . import centroids, decontamination, interactions, jaccard, language, lines, pieces, pii, quality, secrets, substrings, toxicity, vectors

QUERIES = {
    "op1_language": language.op1_language,
    "op2_lines": lines.op2_lines,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_secrets": secrets.op4_secrets,
    "op5_pii": pii.op5_pii,
    "op6_substrings": substrings.op6_substrings,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_embeddings": vectors.op8_embeddings,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_quality": quality.op11_quality,
    "op12_interactions": interactions.op12_interactions,
    "op13_centroids": centroids.op13_centroids,
}

SQL = {
    "op2_lines": lines.ORACLE,
    "op3_decontamination": decontamination.ORACLE,
    "op4_secrets": secrets.ORACLE,
    "op6_substrings": substrings.ORACLE,
    "op8_embeddings": vectors.ORACLE,
    "op10_jaccard": jaccard.ORACLE,
    "op12_interactions": interactions.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
