"""Explicit schemas of every table the engine reads or makes."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "float": T.FloatType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in spec.split(","))])


#: Half-open intervals [st, en) on a chromosome.
LOCUS = _struct("chrom string,st long,en long")
WEIGHTED_LOCUS = _struct("chrom string,st long,en long,weight int")
#: theta comes first; both are read in single precision, as the values were fitted.
BLOCK = _struct("chrom string,st long,en long,theta float,lambda float")
POLY = _struct("chrom string,st long,en long,freq string,maj_idx short,min_idx short")
DICTIONARY = _struct("idx short,tag string")
#: Runs of monomorphic positions with one dictionary code; code 0 (missing) has no row.
MONO_RUN = _struct("chrom string,st long,en long,idx short")
COVARIATE_RUN = _struct("chrom string,st long,en long,tags string")
RESULT = _struct("job string,section string,key string,value string")

# Lengths of the hg19 autosomes.
HG19_AUTOSOMES = {
    "chr1": 249250621, "chr2": 243199373, "chr3": 198022430, "chr4": 191154276, "chr5": 180915260, "chr6": 171115067,
    "chr7": 159138663, "chr8": 146364022, "chr9": 141213431, "chr10": 135534747, "chr11": 135006516, "chr12": 133851895,
    "chr13": 115169878, "chr14": 107349540, "chr15": 102531392, "chr16": 90354753, "chr17": 81195210, "chr18": 78077248,
    "chr19": 59128983, "chr20": 63025520, "chr21": 48129895, "chr22": 51304566,
}
