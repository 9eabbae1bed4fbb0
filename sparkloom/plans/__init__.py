"""plans of sparkloom."""
