"""Readers of archives and loose files, and the parsers behind them."""
