"""tessera: text-annotation analytics on Spark DataFrames.

Label normalisation, redaction, LLM request/reply tables, human-model
triangulation, inter-rater agreement, reproducible sampling and splits,
augmentation with lineage, class weights and multilabel metrics, and Spark ML
training/evaluation, all as DataFrame/SQL plans.
"""

__version__ = "0.1.0"
