"""DataFrame-in, DataFrame-out operators. All are lazy except model fitting."""
