"""Every analysts' table from landed files to its CSV export."""

import struct

from pyspark.sql import functions as F

from terrascore.plans import indicators as ind
from terrascore.plans.reports import REPORTS, run_report
from terrascore.plans.territory import Territory, clean_communes
from terrascore.sources.files import read_delimited

A, B = "200000001", "200000002"
LANDED = {
    "rna_waldec_1.csv": 'id;position;adrs_codeinsee;adrs_codepostal;titre\nW1;A;01001;01400;"un\ndeux"\nW2;D;01001;01400;x\n',
    "rna_waldec_2.csv": "position;id;titre;adrs_codepostal;adrs_codeinsee\nA;W3;y;01400;01001\n",
    "cat_nat.csv": f"Titre\nSource\nCode,Libellé,{ind.DISASTER_COUNT}\n{A},a,6\n",
    "tableur_epci.csv": f"N° SIREN,Nom du groupement,Département,Superficie,Nom membre\n{A},Epci A,?,?,m\n",
    "lieux_covoiturage.csv": f"territoryid,type_lieu,valeur\n{A},{ind.CARPOOL_AREA},3\n",
    "trajets_covoiturage.csv": f"territoryid,valeur\n{A},30\n",
    "dist_urgence.csv": f"Titre\n\nCode,Libellé,{ind.EMERGENCY_DISTANCE}\n01001,x,2\n",
    "dist_pharma.csv": f"Titre\n\nCode,Libellé,{ind.PHARMACY_DISTANCE}\n01001,x,4\n",
    "mediation_numerique.csv": "id,code_insee\n1,01001\n2,01001\n",
    "phyto_relatif.csv": f"siren,pop_tot,total_relatif\n{A},1 000,0.5\n",
    "sau.csv": "codgeo,sau2020\n01001,10\n",
    "ventes_substances.csv": "annee,code_insee,quantite_substance\n2020,01001,1.5\n",
    "zones_urbaines.csv": ",".join(f'"{h}"' for h in ind.URBAN_ZONE_HEADERS) + f'\n{A},a,CA,"10","2,5","25 %"\n',
}
# the row of grouping A in each export
EXPECTED = {
    "associations": {"nb_asso": "2", "asso_per_1000_habitants": "2.0"},
    "catastrophes": {"nb_cat_nat": "6.0", "cat_nat_per_km2": "0.6"},
    "groupements": {"epci_nom": "Epci A", "dept": "01", "superficie_km2": "10.0"},
    "covoiturage": {"nb_aires_covoiturage": "3.0", "nb_covoit_per_10k_hab": "300.0"},
    "distances_soin": {"dist_urgence_moyenne": "2.0", "dist_pharma_moyenne": "4.0"},
    "mediation_numerique": {"total_mediation_epci": "2", "mediation_per_10k_habs": "20.0"},
    "phyto": {"total_relatif": "0.5", "total_sau2020": "10.0"},
    "phyto_annuel": {"annee": "2020", "dept": "01"},
    "zones_urbanisees": {"total_amenagements": "1", "amenagements_per_km2": "0.4"},
}


def test_every_report_is_exported(spark, texts, tmp_path):
    communes = texts(
        ["code_insee", "nom_standard", "code_postal", "reg_code", "dep_code", "epci_code", "epci_nom", "population", "superficie_hectare", "superficie_km2"],
        ["01001", "Alpha", "01400", "84", "01", A, "Epci A", "1000", "1000", "10"], ["02001", "Beta", "02000", "32", "02", B, "Epci B", "500", "2000", "20"])
    perimeter = texts(["dept", "siren", "insee", "total_pop_tot", "total_pop_mun", "nb_membres"], ["01", A, "01001", "1 000", "1 000", "1"],
                      ["02", B, "02001", "2 000", "2 000", "1"])
    territory = Territory(clean_communes(communes), perimeter)
    landed, target = tmp_path / "landed", str(tmp_path / "out")
    landed.mkdir()
    for name, body in LANDED.items():
        (landed / name).write_text(body, encoding="utf-8")
    line = struct.pack("<BII4d", 1, 2, 2, 3.0, 46.5, 3.0, 46.6)
    spark.createDataFrame([(1, "01001", bytearray(line))], "id_osm long, code_com_d string, geometry binary").write.parquet(
        str(landed / "amenagement_cyclable.parquet"))
    assert set(REPORTS) == set(EXPECTED)
    for name, want in EXPECTED.items():
        for _ in range(2):  # a second run replaces the first
            path = run_report(spark, name, str(landed), territory, target)
        found = read_delimited(spark, path).where(F.col("siren") == A).collect()
        assert len(found) == 1, name
        assert {k: found[0][k] for k in want} == want, name
