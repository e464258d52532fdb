"""sparkloom: program analytics and text-corpus operators expressed as Spark plans."""
