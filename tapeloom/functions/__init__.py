"""Part of tapeloom."""
