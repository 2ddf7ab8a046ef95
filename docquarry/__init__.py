"""docquarry: JSON documents in Spark columns — parsing, addressing, comparing, patching and validating them."""
