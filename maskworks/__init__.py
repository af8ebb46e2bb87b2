"""Reversible anonymization of source code and text at corpus scale, as Spark plans."""
