"""Spark operators for earthquake catalogs, phase picks, waveforms and the literature around them.

Everything is a ``DataFrame -> DataFrame`` or ``Column -> Column`` function, so results chain with
``DataFrame.transform`` and Catalyst sees one plan.
"""
