"""Column expressions and the plain functions behind them."""
