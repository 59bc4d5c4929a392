"""foliodex: retrieval, evidence gating and answer grading over paged documents, as Spark plans."""

__version__ = "0.1.0"
